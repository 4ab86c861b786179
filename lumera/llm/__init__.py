"""Training-data operators: deduplication, scoring, mixing, packing and storage of text."""
