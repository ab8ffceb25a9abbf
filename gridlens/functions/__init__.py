"""Column expressions: time, text and ratio helpers, regression statistics."""
