"""Relational building blocks: keyed tables, paging, matching, series."""
