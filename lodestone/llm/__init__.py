"""Training-data operators: scans, mixing, tokens, near duplicates, language, chat."""
