"""operators of the estate analytics."""
