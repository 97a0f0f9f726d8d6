"""Reading, writing and probing tables."""
