"""Training-data operators: quality, duplicates, leaks, sharding, archives, packing, models."""
