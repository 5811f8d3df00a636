"""Column builders; no operator here adds a shuffle."""
