"""Training-data operators: deduplication, filtering, mixing, formatting and token output."""
