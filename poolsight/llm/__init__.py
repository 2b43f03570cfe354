"""Operators for training data at scale, and their queries. Nothing else in the library imports this."""
