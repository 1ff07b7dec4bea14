"""Queries: operators applied to a building that is derived from the given tables."""
