"""Column expressions: text, tags, bits, sampling, vectors."""
