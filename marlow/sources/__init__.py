"""Sources of the marlow engine."""
