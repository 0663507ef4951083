"""Column functions: text, routing, tokens, vectors, answers."""
