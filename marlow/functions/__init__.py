"""Functions of the marlow engine."""
