"""Column functions: money, text, names and references."""
