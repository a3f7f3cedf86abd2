"""Whole calculations put together from the operators."""
