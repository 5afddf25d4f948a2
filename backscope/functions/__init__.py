"""functions of the estate analytics."""
