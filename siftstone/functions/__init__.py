"""Column expressions: text, paths, documents, metrics."""
