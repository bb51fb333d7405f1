"""Logical plans: gridding, spatial queries and the query catalogue."""
