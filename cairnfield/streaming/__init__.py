"""streaming of the point engine."""
