"""plans of the estate analytics."""
