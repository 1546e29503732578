"""Operators for training data: percentiles, frequent items, term statistics, tokens, mixing and splitting.

Nothing outside this subpackage imports it.
"""
