"""Streaming of the marlow engine."""
