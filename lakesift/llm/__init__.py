"""Training-data operators: dedup, tokenizing, scoring, search, mixing and archives."""
