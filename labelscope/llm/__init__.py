"""Training-data operators: counting, cleaning, deduplicating, packing and writing document tables."""
