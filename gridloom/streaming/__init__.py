"""Stateless operators on Structured Streaming frames."""
