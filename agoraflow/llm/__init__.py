"""Training-data operators: language-model scoring, extraction, tokenizing, sharding, filtering and joins over text."""
