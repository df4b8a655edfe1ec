"""Training-data operators: search, scanning, classification, encoding, deduplication, packing."""
