"""Column functions: text, numbers, similarity, quality classes."""
