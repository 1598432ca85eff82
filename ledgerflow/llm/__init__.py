"""Training-data operators: quality, deduplication, tokens, packing, scans."""
