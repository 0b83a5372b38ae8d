"""Operators for preparing training corpora. Nothing else in muxlake imports this package."""
