"""Operators for preparing training corpora, each a DataFrame-to-DataFrame function."""
