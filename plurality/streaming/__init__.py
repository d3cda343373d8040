"""Streaming forms of the row-wise operators and of the running totals."""
