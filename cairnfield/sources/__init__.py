"""sources of the point engine."""
