"""Operators that prepare training data: one module each, their queries in `queries`."""
