"""Training-data operators: packing, scoring, deduplication, extraction, token files."""
