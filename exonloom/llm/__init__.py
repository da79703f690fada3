"""Operators for preparing training data: duplicates, overlaps, splits, leaks, mixes and residue. Nothing outside this
subpackage imports it."""
