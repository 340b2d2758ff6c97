"""Plans of the interval analytics library."""
