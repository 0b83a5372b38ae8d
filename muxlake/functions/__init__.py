"""Scalar functions on columns: clocks, bit fields and code tables."""
