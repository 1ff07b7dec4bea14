"""Operators on tables of a building: geometry joins, graphs, evacuation, catalogue."""
