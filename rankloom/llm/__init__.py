"""Training-data operators: deduplication, filters, tokenisation, packing, mixing, nearest neighbours."""
