"""Readers of building models and writers of their tables."""
