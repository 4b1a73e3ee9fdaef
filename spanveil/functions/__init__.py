"""Column expressions: text in, spans or text out."""
