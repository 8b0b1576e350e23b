"""Training-data operators: quality, deduplication, privacy, token output, language, mixing and packing."""
