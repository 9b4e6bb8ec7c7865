"""Model terms as data, expanded to design columns.

A term is a tuple of atoms; its columns are the products of the atoms' columns. The same
definitions serve Spark columns (scoring, one-pass sums) and NumPy arrays (batches inside a
task), because only three operations differ between the two: log, positive part, indicator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

Term = tuple[str, ...]
INTERCEPT: Term = ()


class SparkOps:
    one = 1.0
    log = staticmethod(F.log)

    @staticmethod
    def positive(x):
        return F.greatest(x, F.lit(0.0))

    @staticmethod
    def cube(x):
        return x * x * x

    @staticmethod
    def is_level(x, level):
        return F.when(x == F.lit(level), 1.0).otherwise(0.0)


class NumpyOps:
    one = 1.0
    log = staticmethod(np.log)

    @staticmethod
    def positive(x):
        return np.maximum(x, 0.0)

    @staticmethod
    def cube(x):
        return x * x * x

    @staticmethod
    def is_level(x, level):
        return (x == level).astype(float)


def natural_spline(x, knots: Sequence[float], ops) -> list:
    """Natural cubic spline basis without intercept: ``len(knots) - 1`` columns.

    ``knots`` include both boundary knots. Truncated powers on the unit scale; the space they
    span, hence every fitted value, is that of any natural cubic basis on the same knots.
    """
    lo, hi = float(knots[0]), float(knots[-1])
    t = (x - lo) / (hi - lo)
    at = [(float(k) - lo) / (hi - lo) for k in knots]

    def d(k):
        return (ops.cube(ops.positive(t - at[k])) - ops.cube(ops.positive(t - at[-1]))) / (at[-1] - at[k])

    tail = d(len(at) - 2)
    return [t] + [d(k) - tail for k in range(len(at) - 2)]


@dataclass(frozen=True)
class Design:
    """Terms of one model, the levels of its factors and the knots of its splines.

    Atoms: a plain column name; ``log(x)``; ``x^2``; ``log(x)^2``; ``ns(x)`` with knots under
    ``x``; a factor listed in ``levels`` (treatment contrasts against the first level, or all
    levels when the factor is listed in ``full``).
    """

    terms: tuple[Term, ...]
    levels: Mapping[str, Sequence] = None
    knots: Mapping[str, Sequence[float]] = None
    full: tuple[str, ...] = ()

    def _atom(self, atom: str, data: Mapping, ops) -> list[tuple[str, object]]:
        if self.levels and atom in self.levels:
            levels = list(self.levels[atom])
            kept = levels if atom in self.full else levels[1:]
            return [(f"{atom}[{lv}]", ops.is_level(data[atom], lv)) for lv in kept]
        if atom.startswith("ns("):
            name = atom[3:-1]
            return [
                (f"{atom}{i + 1}", col)
                for i, col in enumerate(natural_spline(data[name], self.knots[name], ops))
            ]
        squared = atom.endswith("^2")
        base = atom[:-2] if squared else atom
        value = ops.log(data[base[4:-1]]) if base.startswith("log(") else data[base]
        return [(atom, value * value if squared else value)]

    def columns(self, data: Mapping, ops=SparkOps) -> list[tuple[str, object]]:
        out = []
        for term in self.terms:
            cells = [("", None)]
            for atom in term:
                cells = [
                    (f"{name}:{a}" if name else a, value if prior is None else prior * value)
                    for name, prior in cells
                    for a, value in self._atom(atom, data, ops)
                ]
            out += [(name or "(Intercept)", ops.one if value is None else value) for name, value in cells]
        return out

    def names(self) -> list[str]:
        return [name for name, _ in self.columns(_Anything(), _NameOps)]

    def matrix(self, data: Mapping[str, np.ndarray], rows: int) -> np.ndarray:
        cols = self.columns(data, NumpyOps)
        return np.column_stack([np.broadcast_to(np.asarray(v, dtype=float), rows) for _, v in cols])

    def linear(self, coefficients: Sequence[float], data: Mapping | None = None):
        """Linear predictor as a Spark column."""
        total = F.lit(0.0)
        for (_, value), beta in zip(self.columns(data or _ColumnsByName()), coefficients):
            total = total + value * F.lit(float(beta))
        return total


class _ColumnsByName(dict):
    def __missing__(self, name):
        return F.col(name)


class _Anything(dict):
    def __missing__(self, name):
        return 2.0


class _NameOps(NumpyOps):
    @staticmethod
    def is_level(x, level):
        return 1.0


def main_effects(*atoms: str) -> tuple[Term, ...]:
    return (INTERCEPT, *[(a,) for a in atoms])


def crossed(*atoms: str, by: str) -> tuple[Term, ...]:
    """``(a + b) * by``: main effects and their products with ``by``."""
    return (INTERCEPT, *[(a,) for a in atoms], (by,), *[(a, by) for a in atoms])


TIME, AREA = "TimeSinceFire", "AREA"

# Candidate hazard models: name -> fixed terms.
SURVIVAL_MODELS = {
    "baseline": (INTERCEPT,),
    "ht": main_effects("HT"),
    "ht_area": main_effects("HT", AREA),
    "ht_area_htarea": crossed("HT", by=AREA),
    "ht_area_time": main_effects("HT", AREA, TIME),
    "ht_area_htarea_time": (*crossed("HT", by=AREA), (TIME,)),
    "ht2_area_time": main_effects("HT", "HT^2", AREA, TIME),
    "ht2_area_htarea_time": (*crossed("HT", "HT^2", by=AREA), (TIME,)),
    "htLL_area_time": main_effects("HT", "log(HT)", AREA, TIME),
    "htLL_area_htarea_time": (*crossed("HT", "log(HT)", by=AREA), (TIME,)),
    "htLog_area_time": main_effects("log(HT)", AREA, TIME),
    "htLog_area_htarea_time": (*crossed("log(HT)", by=AREA), (TIME,)),
    "htS_area_time": main_effects("ns(HT)", AREA, TIME),
    "htS_area_htarea_time": (*crossed("ns(HT)", by=AREA), (TIME,)),
}

INTERVAL = ("CensusInterval",)

# Candidate growth models for log next size: name -> fixed terms.
GROWTH_MODELS = {
    "baseline": (INTERCEPT, INTERVAL),
    "ht_area": (*main_effects("log(HT)", AREA), INTERVAL),
    "ht2_area": (*main_effects("log(HT)", "log(HT)^2", AREA), INTERVAL),
    "ht_area_htarea": (*crossed("log(HT)", by=AREA), INTERVAL),
    "ht2_area_htarea": (*crossed("log(HT)", "log(HT)^2", by=AREA), INTERVAL),
    "ht_area_time": (*main_effects("log(HT)", AREA, TIME), INTERVAL),
    "ht2_area_time": (*main_effects("log(HT)", "log(HT)^2", AREA, TIME), INTERVAL),
    "ht_area_htarea_time": (*crossed("log(HT)", by=AREA), (TIME,), INTERVAL),
    "ht2_area_htarea_time": (*crossed("log(HT)", "log(HT)^2", by=AREA), (TIME,), INTERVAL),
}
