"""Column functions and shared helpers."""
