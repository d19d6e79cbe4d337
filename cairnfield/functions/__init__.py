"""functions of the point engine."""
