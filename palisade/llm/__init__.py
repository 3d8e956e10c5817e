"""Operators for preparing training corpora. Nothing else in palisade imports this package."""
