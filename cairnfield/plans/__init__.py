"""plans of the point engine."""
