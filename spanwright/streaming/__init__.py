"""Streaming of the interval analytics library."""
