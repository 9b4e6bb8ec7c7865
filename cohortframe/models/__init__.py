"""Vital-rate estimators.

Closed forms are plain aggregates. Iterative fits repeat one pass over the panel per step: each
task reduces its rows to a small vector per fit, Spark adds the vectors, the driver solves one
p x p system per fit.
"""
