"""Training-data operators: dedup, search, scans, packing, language, mixing, sketches."""
