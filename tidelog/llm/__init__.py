"""Training-data operators: scoring, de-duplication, scanning, mixing, packing, sharding."""
