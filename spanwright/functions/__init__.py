"""Functions of the interval analytics library."""
