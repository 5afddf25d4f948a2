"""sources of the estate analytics."""
