"""Training-data operators: scoring, filtering, deduplication, sharding, mixing, tokenising."""
