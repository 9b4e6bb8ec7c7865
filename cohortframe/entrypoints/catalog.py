"""All registered queries."""

from __future__ import annotations

from . import cleaning, fitting, modelling, panels  # noqa: F401  (registration on import)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
