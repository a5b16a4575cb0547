"""Training-data operators: deduplication, filtering, packing, tokenisation, search and archives."""
