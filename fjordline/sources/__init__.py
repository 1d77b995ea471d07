"""Readers of bars, quotes and saved results."""
