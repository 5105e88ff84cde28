"""Column functions on label texts."""
