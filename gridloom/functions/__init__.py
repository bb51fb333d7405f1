"""Functions of the grid engine."""
