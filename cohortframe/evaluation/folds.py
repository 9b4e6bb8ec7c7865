"""Fold plans over the panel's own censuses and sites, as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.summary import sites_for_holdout


@dataclass(frozen=True)
class Fold:
    """One train/test split: censuses or a site on each side."""

    scheme: str
    fold: int
    train_censuses: tuple[int, ...] | None = None
    test_censuses: tuple[int, ...] | None = None
    held_site: str | None = None

    def train(self) -> Column:
        if self.held_site is not None:
            return F.col("SITEAREA") != self.held_site
        return F.lit(True) if self.train_censuses is None else F.col("CENSUS_NUM").isin(list(self.train_censuses))

    def test(self) -> Column:
        if self.held_site is not None:
            return F.col("SITEAREA") == self.held_site
        return F.lit(True) if self.test_censuses is None else F.col("CENSUS_NUM").isin(list(self.test_censuses))

    def fingerprint(self, present: Sequence[int]) -> tuple:
        """What the training set really is: equal fingerprints need one fit."""
        if self.held_site is not None:
            return ("site", self.held_site)
        if self.train_censuses is None:
            return ("all",)
        kept = tuple(c for c in present if c in self.train_censuses)
        return ("all",) if kept == tuple(present) else ("census", *kept)


def full_fit() -> Fold:
    return Fold("full", 0)


def holdout(present: Sequence[int], last_train: int = 9) -> Fold:
    return Fold(
        "holdout",
        1,
        tuple(c for c in present if c <= last_train),
        tuple(c for c in present if c > last_train),
    )


def expanding(
    present: Sequence[int], folds: int = 3, min_train: int = 8, test_size: int = 4, unit: str = "number"
) -> list[Fold]:
    """Expanding windows: ``unit="number"`` counts census numbers, ``"level"`` distinct censuses present."""
    axis = list(range(1, max(present) + 1)) if unit == "number" else list(present)
    out = []
    for i in range(1, folds + 1):
        end = min_train + i - 1
        train, test = axis[:end], axis[end : end + test_size]
        if unit == "number":
            test = list(range(end + 1, end + 1 + test_size))
        kept = tuple(c for c in test if c in present)
        out.append(Fold("expanding", i, tuple(c for c in train if c in present), kept))
    return out


def site_out(sites: Sequence[str]) -> list[Fold]:
    return [Fold("site", i + 1, held_site=s) for i, s in enumerate(sites)]


def present_censuses(panel: DataFrame) -> list[int]:
    return [r[0] for r in panel.select("CENSUS_NUM").distinct().orderBy("CENSUS_NUM").collect()]


def holdout_sites(panel: DataFrame) -> list[str]:
    return [r[0] for r in sites_for_holdout(panel).select("SITEAREA").distinct().orderBy("SITEAREA").collect()]


def plan(
    panel: DataFrame,
    last_train: int = 9,
    folds: int = 3,
    min_train: int = 8,
    test_size: int = 4,
    unit: str = "number",
    schemes: Sequence[str] = ("full", "holdout", "expanding", "site"),
) -> list[Fold]:
    present = present_censuses(panel)
    out: list[Fold] = []
    if "full" in schemes:
        out.append(full_fit())
    if "holdout" in schemes:
        out.append(holdout(present, last_train))
    if "expanding" in schemes:
        out += expanding(present, folds, min_train, test_size, unit)
    if "site" in schemes:
        out += site_out(holdout_sites(panel))
    return out


def fold_table(panel: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows and events on both sides of every fold, all folds in one pass over the panel."""
    aggs = []
    for i, f in enumerate(folds):
        aggs += [F.count_if(f.train()).alias(f"train_{i}"), F.count_if(f.test()).alias(f"test_{i}")]
    counted = panel.agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(f.scheme).alias("scheme"),
                F.lit(f.fold).alias("fold"),
                F.lit(f.held_site).cast("string").alias("held_site"),
                F.col(f"train_{i}").alias("n_train"),
                F.col(f"test_{i}").alias("n_test"),
            )
            for i, f in enumerate(folds)
        ]
    )
    return counted.select(F.explode(cells).alias("f")).select("f.*")
