"""Buzz analytics for listed stocks, written as plain PySpark.

Every public function takes DataFrames or Columns and returns them; nothing is
executed until the caller writes or collects, except where a docstring says so.
"""
