"""Operators of the interval analytics library."""
