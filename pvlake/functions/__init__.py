"""Column expressions: no shuffle, no Python in the data path."""
