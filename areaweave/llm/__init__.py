"""Training-data operators: language, tokens, duplicates, leaks, quality, secrets."""
