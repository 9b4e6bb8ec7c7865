"""Longitudinal panel (repeated-census) analytics on PySpark.

Layers, from the bottom up:

* ``sources``    readers, writers, string repairs, panels built from star-schema tables
* ``functions``  column expressions: bins, ranks, intervals, basis terms, links
* ``operators``  DataFrame -> DataFrame steps: cleaning, status resolution, reshape,
  transitions, cohort panels, summaries, distributions
* ``models``     vital-rate estimators fitted from aggregated sufficient statistics
* ``evaluation`` folds, metrics, ranking, residual shape
* ``plans``      composed workflows: raw census to panel, panel to ranked models
"""

__version__ = "0.1.0"
