"""Training-data operators: quality, duplicates, private data, packing and output."""
