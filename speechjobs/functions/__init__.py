"""Column functions: symbols, alignment, scores, gates."""
