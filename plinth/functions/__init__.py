"""Column expressions: geometry and text."""
