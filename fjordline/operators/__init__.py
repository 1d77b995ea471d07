"""Operators over bar panels, labels, folds, predictions and runs."""
