"""Training-data operators: counting, packing, formatting, filtering and deduplicating text at scale."""
