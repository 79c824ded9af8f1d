"""Operators for language training data. Nothing outside this package imports it."""
