"""Listing analytics on Spark: text to typed, deduplicated, scored records."""
