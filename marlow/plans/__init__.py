"""Plans of the marlow engine."""
