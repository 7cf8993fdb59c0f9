"""Operators for building training data and linking records; nothing else in the library imports this package."""
