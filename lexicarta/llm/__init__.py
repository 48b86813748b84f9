"""Operators for training data: near-duplicates, leaks, mixes, code and text quality."""
