"""Streaming of the grid engine."""
