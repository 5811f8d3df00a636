"""Date-aware retrieval, alignment and evaluation over versioned text, as lazy Spark plans."""
