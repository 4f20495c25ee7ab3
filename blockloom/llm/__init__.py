"""Corpus preparation: splits, canonical names, percentiles, tokens, leaks, pieces."""
