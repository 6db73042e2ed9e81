"""Operators that choose, order, mix and pack training data. Nothing outside this folder imports it."""
