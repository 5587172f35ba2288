"""Training-data operators: de-duplication, tokenising, packing, sanitising, extraction and quality."""
