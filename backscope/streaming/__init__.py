"""streaming of the estate analytics."""
