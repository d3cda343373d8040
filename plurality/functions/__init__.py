"""Column-valued functions: distributions, keys and text."""
