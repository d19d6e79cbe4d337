"""operators of the point engine."""
