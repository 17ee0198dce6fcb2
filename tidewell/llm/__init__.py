"""Training-data operators: token counts, quality, dedup, archives, mixing."""
