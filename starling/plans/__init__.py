"""Whole fits put together from operators."""
