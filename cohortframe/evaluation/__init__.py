"""Folds, metrics, ranking and residual shape."""
