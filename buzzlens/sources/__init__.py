"""Readers and parsers of the incoming feeds, and the time-series tables."""
