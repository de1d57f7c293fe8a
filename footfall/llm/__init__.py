"""Training-data operators (corpus cleaning, dedup, packing). Nothing outside imports this package."""
