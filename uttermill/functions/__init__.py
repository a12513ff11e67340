"""Column expressions: text cleaning, tokens, scores."""
