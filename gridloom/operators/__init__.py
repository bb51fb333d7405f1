"""Operators of the grid engine."""
