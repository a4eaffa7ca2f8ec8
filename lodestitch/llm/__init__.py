"""Operators that prepare training data from very large text corpora."""
