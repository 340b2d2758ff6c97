"""Sources of the interval analytics library."""
