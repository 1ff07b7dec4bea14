"""Training-data operators: deduplication, filtering, scoring, tokenising, archives."""
