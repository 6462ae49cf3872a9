"""Operators of the marlow engine."""
