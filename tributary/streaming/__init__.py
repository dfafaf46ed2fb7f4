"""Products that grow with a stream."""
