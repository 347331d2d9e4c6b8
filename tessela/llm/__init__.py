"""Operators on training-data text and metrics, with their queries."""
