"""Variance components of many fits at once, and predictions that use the effects.

A search evaluates a small grid of variances around its centre. All searches of a call put their grid points into
the same passes over the rows, each with its own centre and width, its own warm start and its own end; the
number of passes is that of the longest search, not of all together.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import engine
from .engine import (
    Effects, Fit, Rows, _add_vectors, _batch, _individual_modes, _matrix, _starts, binary_or_size, fit_effects,
    fit_effects_together, named_scores, whole_groups,
)
from .families import FAMILIES, LINK_MEAN

SINGULAR_SD = 0.02
SD_BOUNDS = (math.log(0.005), math.log(5.0))


@dataclass
class _Search:
    """Where one fit's search stands: the centre in log sd, the half-width of the grid, the best fit so far."""

    fit: Fit
    centre: np.ndarray
    half: float
    effects: Effects = field(default_factory=dict)
    settled: bool = False
    free: np.ndarray = field(default_factory=lambda: np.arange(1))  # the axes that are searched; others are at zero

    def grid(self) -> np.ndarray:
        """The centre, a step up and down each axis, and two corners: enough for a quadratic surface."""
        d = len(self.free)
        offsets = [o for o in itertools.product((-1.0, 0.0, 1.0), repeat=d) if np.abs(o).sum() <= 1 or abs(sum(o)) == d]
        points = np.tile(self.centre, (len(offsets), 1))
        points[:, self.free] += self.half * np.array(offsets)
        return np.unique(np.clip(points, *SD_BOUNDS), axis=0)

    def at(self, point: np.ndarray) -> Fit:
        """The fit at a point; an individual's sd at its boundary needs no modes."""
        sd = np.exp(point)
        return replace(self.fit, sd_plot=float(sd[0]), sd_ind=float(sd[1]) if 1 in self.free else 0.0)

    def move(self, points: np.ndarray, found: Sequence[Fit], effects: Sequence[Effects], smallest: float) -> None:
        """Follow the rim while the best point lies on it; else narrow around the peak of the surface.

        The search ends when a grid of half-width ``smallest`` holds its own peak, or when the likelihood falls
        towards the lower bound of an sd, which then is a zero boundary.
        """
        errors = [f.error for f in found]
        values = np.array([-np.inf if f.error else f.loglik for f in found])
        if not np.isfinite(values).any():
            self.fit, self.settled = replace(self.fit, error=errors[0]), True
            return
        best = int(np.argmax(values))
        top, self.fit, self.effects = points[best], found[best], effects[best]
        moved = np.abs(top - self.centre) > 1e-9
        low = top <= SD_BOUNDS[0] + 1e-9
        if np.any(moved & ~low) and not np.all(low[self.free]):
            self.centre = np.clip(top, *SD_BOUNDS)
            return
        fine = np.isfinite(values)
        free = self.free
        peak = _surface_peak(points[fine][:, free], values[fine], self.centre[free], self.half)
        self.centre = top.copy()
        if peak is not None and np.all(np.abs(peak - top[free]) <= self.half):
            self.centre[free] = np.where(low[free], SD_BOUNDS[0], np.clip(peak, *SD_BOUNDS))
        self.settled = self.half <= smallest
        self.half = max(self.half / 2.5, smallest)


def _surface_peak(points: np.ndarray, values: np.ndarray, centre: np.ndarray, half: float) -> np.ndarray | None:
    """Maximum of a quadratic through the grid, or None unless it curves down everywhere."""
    d = points.shape[1]
    t = (points - centre) / half
    basis = [np.ones(len(t)), *t.T, *[t[:, i] * t[:, j] for i in range(d) for j in range(i, d)]]
    coef = np.linalg.lstsq(np.column_stack(basis), values, rcond=None)[0]
    quad, k = np.zeros((d, d)), 1 + d
    for i in range(d):
        for j in range(i, d):
            quad[i, j] += coef[k] / (1 if i == j else 2)
            quad[j, i] = quad[i, j]
            k += 1
    if np.any(np.linalg.eigvalsh(quad) >= -1e-9):
        return None
    return centre + half * np.linalg.solve(-2 * quad, coef[1 : 1 + d])


def _evaluate(rows: Rows, fits: Sequence[Fit], begin: Sequence[Effects], steps: int, tol: float):
    """Joint modes of all fits in as few passes as the bound on plot effects allows."""
    together = engine.BROADCAST_CELLS // max(rows.n_plots, 1)
    if together == 0:  # more plots than the driver may hold: their effects stay a table
        found, _ = fit_effects(rows, fits, steps, tol)
        return found, [{} for _ in found]
    out, effects = [], []
    for k in range(0, len(fits), together):
        some, more = fit_effects_together(rows, fits[k : k + together], begin[k : k + together], steps, tol)
        out += some
        effects += more
    return out, effects


def boundary_slopes(rows: Rows, fits: Sequence[Fit]) -> dict[int, tuple[float, float]]:
    """Slopes of the log-likelihood in the variances of plot and individual, where both are zero, for each fit.

    At the optimum without random intercepts the slope in a variance is half the sum over its groups of the squared
    score minus the observed information, as the other parameters' slopes are zero. One pass for all fits; scores of a
    plot are added before they are squared, wherever its rows are.
    """
    narrow = rows.narrow()
    h = 1e-4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ("__plot", "__ind")):
            data, y, o, z, weight = _batch(pdf, narrow)
            mask, plot, ind = pdf["__m"].to_numpy(), pdf["__plot"].to_numpy(), pdf["__ind"].to_numpy()
            out, made, x = [], None, None
            for i, fit in enumerate(fits):
                pick = np.flatnonzero((mask >> fit.train) & 1)
                if fit.error is not None or not len(pick):
                    continue
                if made is not fit.design:
                    made, x = fit.design, fit.design.matrix(data, len(pdf))
                family, zk = FAMILIES[fit.family], np.zeros(len(pick)) if fit.flat_scale else z[pick]
                eta = x[pick] @ fit.beta + o[pick]
                down, mid, up = (family(y[pick], eta + s, fit.aux, zk)[1] for s in (-h, 0.0, h))
                w = (down - up) / (2 * h)
                groups = _starts(plot[pick], ind[pick])
                often = weight[pick]
                slope = 0.5 * float((np.add.reduceat(mid, groups) ** 2 - np.add.reduceat(w, groups)) @ often[groups])
                out.append((i, None, 0.0, slope))
                starts = _starts(plot[pick])
                sums = np.add.reduceat(mid * often, starts), np.add.reduceat(w * often, starts)
                out += [(i, p, float(g), float(k)) for p, g, k in zip(plot[pick][starts], *sums)]
            yield pd.DataFrame(out, columns=["fit", "plot", "g", "w"])

    sums = rows.df.mapInPandas(run, "fit int, plot string, g double, w double").groupBy("fit", "plot").agg(
        F.sum("g").alias("g"), F.sum("w").alias("w")
    )
    of_plot = F.when(F.col("plot").isNotNull(), 0.5 * (F.col("g") * F.col("g") - F.col("w")))
    slopes = sums.groupBy("fit").agg(F.sum(of_plot), F.sum(F.when(F.col("plot").isNull(), F.col("w")))).collect()
    return {r[0]: (r[1], r[2]) for r in slopes}


def search_variances(
    rows: Rows,
    fixed: Sequence[Fit],
    individual: bool,
    centres: Sequence[np.ndarray] | float = 0.3,
    half: float = 1.0,
    rounds: int = 20,
    steps: int = 8,
    final_steps: int = 12,
    smallest: float = 0.12,
    tol: float = 1e-4,
    begin: Sequence[Effects] | None = None,
    afresh: float = 0.3,
) -> tuple[list[Fit], list[Effects]]:
    """Random intercepts by plot (and individual) for every fit, variances by Laplace likelihood.

    ``centres`` is an sd or, for each fit, the log sds from which its search starts. ``converged`` needs a search
    that settled and a fit that converged; ``rounds`` only stops a search that does neither, and says so. Fixed effects
    sit at the joint mode, the usual fast approximation to the full Laplace optimum. A fit that comes with an error
    keeps it and takes no part. Fits whose likelihood falls in every variance from zero on are at that boundary
    already (``boundary_slopes``): they keep their fixed effects, with sds at the lower bound and no plot effects. Where one
    variance alone falls from zero on, the other is searched by itself: intercepts of the other kind only take from
    what is left to explain.
    """
    d = 2 if individual else 1
    slopes = boundary_slopes(rows, fixed)
    lowest = math.exp(SD_BOUNDS[0])
    free = {i: [k for k in range(d) if not fixed[i].converged or s[k] > 0] for i, s in slopes.items()}
    at_zero = {i for i, axes in free.items() if not axes}
    fixed = [
        replace(f, sd_plot=lowest, sd_ind=lowest if individual else 0.0) if i in at_zero else f for i, f in enumerate(fixed)
    ]
    if isinstance(centres, float):
        centres = [np.full(d, math.log(centres)) for _ in fixed]
    searches = [
        _Search(f, np.array(c, float), half, dict(begin[i]) if begin else {}, f.error is not None or i in at_zero)
        for i, (f, c) in enumerate(zip(fixed, centres))
    ]
    for i, s in enumerate(searches):
        s.free = np.array(free.get(i) or range(d))
        bound = np.setdiff1d(np.arange(d), s.free)
        s.centre[bound] = SD_BOUNDS[0]
        stuck = s.free[s.centre[s.free] <= SD_BOUNDS[0] + 1e-6]
        if len(stuck):  # rises from zero here, though not where the centre comes from: start anew
            s.centre[stuck], s.half = math.log(afresh), 1.0
    for _ in range(rounds):
        open_ = [s for s in searches if not s.settled]
        if not open_:
            break
        grids = [s.grid() for s in open_]
        fits = [s.at(p) for s, grid in zip(open_, grids) for p in grid]
        starts = [s.effects for s, grid in zip(open_, grids) for _ in grid]
        found, effects = _evaluate(rows, fits, starts, steps, tol)
        k = 0
        for s, grid in zip(open_, grids):
            s.move(grid, found[k : k + len(grid)], effects[k : k + len(grid)], smallest)
            k += len(grid)
    for i in at_zero:
        searches[i].effects = {}
    usable = [i for i, s in enumerate(searches) if s.fit.error is None and i not in at_zero]
    chosen, effects = _evaluate(
        rows, [searches[i].at(searches[i].centre) for i in usable], [searches[i].effects for i in usable], final_steps, tol
    )
    out, all_effects = [s.fit for s in searches], [s.effects for s in searches]
    for i, fit, found_effects in zip(usable, chosen, effects):
        sd_ind = lowest if individual and fit.sd_ind == 0 else fit.sd_ind
        out[i] = replace(fit, sd_ind=sd_ind, converged=bool(fit.converged and searches[i].settled))
        all_effects[i] = found_effects
    return out, all_effects


# --- individuals --------------------------------------------------------------------------


def _modes(fit: Fit, a, y, o, z, v, group, n_groups) -> np.ndarray:
    eta = a @ fit.beta + o + v
    return _individual_modes(fit, FAMILIES[fit.family], y, eta, np.zeros(len(y)) if fit.flat_scale else z, group, n_groups)[0]


def individual_effects(rows: Rows, fits: Sequence[Fit], effects: Sequence[Effects]) -> DataFrame:
    """``fit, ind, u``: the mode of every individual's intercept given each fit, from its training rows.

    A second stream of the batches that hold the individuals; nothing is collected.
    """
    if rows.merged:
        raise ValueError("rows of merged individuals have lost their names; prepare them without merge")
    shared = rows.df.sparkSession.sparkContext.broadcast(_matrix(effects))
    narrow = rows.narrow()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ("__plot", "__ind")):
            data, y, o, z, weight = _batch(pdf, narrow)
            mask, plot, ind = pdf["__m"].to_numpy(), pdf["__plot"].to_numpy(), pdf["__ind"].to_numpy()
            for i, fit in enumerate(fits):
                pick = np.flatnonzero((mask >> fit.train) & 1)
                if fit.error is not None or fit.sd_ind == 0 or not len(pick):
                    continue
                starts = _starts(plot[pick], ind[pick])
                group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pick))))
                v = shared.value.of(i, plot[pick][starts])[group]
                a = fit.design.matrix(data, len(pdf))[pick]
                u = _modes(fit, a, y[pick], o[pick], z[pick], v, group, len(starts))
                yield pd.DataFrame({"fit": i, "plot": plot[pick][starts], "ind": ind[pick][starts], "u": u})

    return rows.df.mapInPandas(run, "fit int, plot string, ind long, u double")


def score_conditional(rows: Rows, tasks: Sequence[tuple[int, Fit, int]], effects: Sequence[Effects], kind: str) -> list[dict]:
    """``engine.score_sets`` with the effects of plot and individual in the prediction.

    ``tasks`` are (number of the fit in ``effects``, fit, test set). An individual's rows stand together, so its
    effect comes from its training rows in the batch that also holds its test rows; an individual or a plot without
    training rows has effect 0.
    """
    shared = rows.df.sparkSession.sparkContext.broadcast(_matrix(effects))
    narrow = rows.narrow()
    usable = [(k, *t) for k, t in enumerate(tasks) if t[1].error is None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in whole_groups(batches, ("__plot", "__ind")):
            data, y, o, z, weight = _batch(pdf, narrow)
            mask, test, plot, ind = (pdf[c].to_numpy() for c in ("__m", "__t", "__plot", "__ind"))
            starts = _starts(plot, ind)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
            plots = _starts(plot)
            of_plot = np.repeat(np.arange(len(plots)), np.diff(np.append(plots, len(pdf))))
            known: dict[int, np.ndarray] = {}
            for k, i, fit, t in usable:
                inside = (test >> t) & 1 == 1
                if not inside.any():
                    continue
                if i not in known:
                    a = fit.design.matrix(data, len(pdf))
                    v = shared.value.of(i, plot[plots])[of_plot]
                    eta = a @ fit.beta + o + v
                    pick = np.flatnonzero((mask >> fit.train) & 1)
                    if fit.sd_ind > 0 and len(pick):
                        eta = eta + _modes(fit, a[pick], y[pick], o[pick], z[pick], v[pick], group[pick], len(starts))[group]
                    known[i] = LINK_MEAN[fit.family](eta)
                vec = binary_or_size(known[i][inside], y[inside], weight[inside], kind)
                totals[k] = totals[k] + vec if k in totals else vec
        if totals:
            yield pd.DataFrame(list(totals.items()), columns=["fit", "stats"])

    sums = _add_vectors(rows.df.mapInPandas(run, "fit int, stats array<double>"), "stats")
    return named_scores(sums, len(tasks), kind)
