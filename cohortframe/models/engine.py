"""Distributed scoring steps for many fits at once.

One pass over the panel serves every (model, training set, variance) combination: a task turns
each batch of rows into one short vector per fit, Spark adds the vectors, the driver solves a
p x p system per fit. Rows are never copied per fold; a bit mask says which training sets a row
belongs to.

Rows that agree in all that a fit sees are merged and carry their number as a weight, which changes no sum. Fits without
intercepts of individuals read rows merged over individuals; fits with them can read individuals of a plot that have the same
rows as one.

Random intercepts of individuals and plots are integrated out by Laplace's method at the joint
mode. Rows of an individual are contiguous in one partition, so its effect is found inside the
batch and never stored. Plot effects are a table; plots too large for one task are split over
several by a salt derived from their row count, and their partial sums are added afterwards.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import level_ordinal
from ..functions.terms import Design
from ..session import cut_lineage
from ..evaluation.metrics import LOGLOSS_EPSILON
from .families import FAMILIES, LINK_MEAN, SCORES, SHAPE, nu_constants

# Batch functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

ROWS_PER_TASK = 250_000
BROADCAST_CELLS = 2_000_000
SHAPE_STEP = 0.02
MASK_BITS = 62
MODE_STEPS, MODE_STOP = 25, 1e-7


class Coded:
    """A factor as integer codes; compared with a level by its code."""

    def __init__(self, codes: np.ndarray, levels: Sequence):
        self.codes, self.levels = codes, list(levels)

    def __eq__(self, level):
        return self.codes == self.levels.index(level) + 1


@dataclass(frozen=True)
class Fit:
    """State of one fit between passes."""

    model: str
    design: Design
    family: str
    train: int = 0
    fold: str = "full"
    beta: np.ndarray | None = None
    aux: dict = field(default_factory=dict)
    sd_plot: float = 0.0
    sd_ind: float = 0.0
    loglik: float = -np.inf
    covariance: np.ndarray | None = None
    n: int = 0
    step: float = 1.0
    delta: np.ndarray | None = None
    converged: bool = False
    error: str | None = None
    iterations: int = 0
    flat_scale: bool = False  # t family: one scale instead of a scale changing with z

    @property
    def parameters(self) -> int:
        shape = 1 if self.family in SHAPE else 0
        scale = 2 - self.flat_scale if self.family == "student" else 1 if self.family == "gaussian" else 0
        return len(self.beta) + shape + scale + (self.sd_plot > 0) + (self.sd_ind > 0)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters


@dataclass(frozen=True)
class Rows:
    """Prepared rows: ``__y, __o, __z, __m, __t, __plot, __ind``, their weight ``__w`` and the raw atoms of the designs.

    ``flat`` holds the same rows merged over individuals, for whatever needs no effects of individuals.
    """

    df: DataFrame
    numeric: tuple[str, ...]
    factors: dict[str, tuple]
    n_plots: int = 0
    split: bool = False  # whether some plot is dealt out over several tasks
    flat: Rows | None = None
    merged: bool = False  # whether an ``__ind`` may stand for several individuals

    @property
    def plain(self) -> Rows:
        return self.flat or self

    def narrow(self) -> Rows:
        """Without tables, as tasks need it."""
        return replace(self, df=None, flat=None)

    def means(self, *columns: str) -> list[float]:
        of = self.plain.df
        return list(of.agg(*[F.sum(F.col(c) * F.col("__w")) / F.sum("__w") for c in columns]).first())

    def release(self) -> None:
        self.df.unpersist()
        if self.flat is not None:
            self.flat.release()


def prepare(
    df: DataFrame,
    y: Column,
    numeric: Sequence[str],
    factors: dict[str, Sequence] | None = None,
    offset: Column | None = None,
    z: Column | None = None,
    train_sets: Sequence[Column] = (),
    test_sets: Sequence[Column] = (),
    plot: str | None = None,
    ind: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    merge: bool = False,
    weight: str | None = None,
) -> Rows:
    """Keep complete rows and the columns the fits need; persisted for the passes to come.

    ``merge`` takes individuals of a plot with the same rows as one, with their number as weight. ``weight`` names the column
    of rows that ``merge_rows`` has merged already; they have no individuals.
    """
    if weight is not None and ind is not None:
        raise ValueError("merged rows have no individuals")
    factors = {k: tuple(v) for k, v in (factors or {}).items()}
    chosen = df.select(
        y.cast("double").alias("__y"),
        (F.lit(0.0) if offset is None else offset).cast("double").alias("__o"),
        (F.lit(0.0) if z is None else z).cast("double").alias("__z"),
        set_mask(train_sets or [F.lit(True)]).alias("__m"),
        set_mask(test_sets or [F.lit(True)]).alias("__t"),
        (F.lit("") if plot is None else F.col(plot).cast("string")).alias("__plot"),
        _row_key(df, ind).cast("long").alias("__ind"),
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[level_ordinal(c, levels).alias(c) for c, levels in factors.items()],
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("__w"),
    ).dropna()
    seen = [c for c in chosen.columns if c not in ("__ind", "__w")]
    if plot is None or ind is None:
        cells = chosen.groupBy(*seen).agg(F.sum("__w").alias("__w"))
        return _dealt(cells.withColumn("__ind", F.xxhash64(*seen)), numeric, factors, plot is not None, rows_per_task)
    single = _histories(chosen.drop("__w")) if merge else chosen
    rows = _dealt(single, numeric, factors, True, rows_per_task)
    cells = rows.df.groupBy(*seen).agg(F.sum("__w").alias("__w")).withColumn("__ind", F.xxhash64(*seen))
    return replace(rows, flat=_dealt(cells, numeric, factors, True, rows_per_task), merged=merge)


def merge_rows(df: DataFrame, columns: Sequence[str], number: str = "__n") -> DataFrame:
    """The distinct rows of ``columns`` with their number: one exchange of what is left after each task has merged its own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(number))


def _histories(df: DataFrame) -> DataFrame:
    """One individual for all of a plot that have the same rows, which then count that often."""
    seen = [c for c in df.columns if c not in ("__plot", "__ind")]
    each = df.groupBy("__plot", "__ind").agg(F.array_sort(F.collect_list(F.struct(*seen))).alias("__rows"))
    merged = each.groupBy("__plot", "__rows").agg(
        F.count(F.lit(1)).cast("double").alias("__w"), F.min("__ind").alias("__ind")
    )
    return merged.select("__plot", "__ind", "__w", F.explode("__rows").alias("__row")).select(
        "__plot", "__ind", "__w", "__row.*"
    )


def _dealt(df: DataFrame, numeric, factors, by_plot: bool, rows_per_task: int) -> Rows:
    """Rows dealt out to tasks and persisted: by plot, a large one over several tasks, or evenly."""
    if not by_plot:
        # Passes are bound by computation, not by bytes: keep them from being coalesced.
        return Rows(df.repartition(task_count(df), "__ind").persist(), tuple(numeric), factors)
    df = df.persist()
    sizes = df.groupBy("__plot").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task)).cast("int").alias("__salts"))
    salted = df.join(sizes, "__plot").withColumn("__salt", F.pmod(F.xxhash64("__ind"), "__salts")).drop("__salts")
    out = cluster(salted).persist()
    n_plots, salts = out.agg(F.count_distinct("__plot"), F.max("__salt")).first()
    df.unpersist()
    return Rows(out, tuple(numeric), factors, n_plots, bool(salts))


def _row_key(df: DataFrame, ind: str | None) -> Column:
    """What rows are dealt out by: the individual, else all columns, so that equal responses don't share a task."""
    if ind is not None:
        return F.col(ind)
    return F.xxhash64("IND_ID") if "IND_ID" in df.columns else F.xxhash64(*df.columns)


def set_mask(conditions: Sequence[Column]) -> Column:
    """One bit per row set; callers split longer lists over several calls."""
    if len(conditions) > MASK_BITS:
        raise ValueError(f"at most {MASK_BITS} row sets per pass, got {len(conditions)}")
    mask = F.lit(0).cast("long")
    for i, condition in enumerate(conditions):
        mask = mask + F.when(condition, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def task_count(df: DataFrame) -> int:
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)


def cluster(df: DataFrame) -> DataFrame:
    return df.repartition(task_count(df), "__plot", "__salt").sortWithinPartitions("__plot", "__ind")


# --- inside a task ----------------------------------------------------------------------


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no group of ``keys`` is split; holds back one group at most."""
    held = None
    for batch in batches:
        if batch.empty:
            continue
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        last = np.ones(len(batch), dtype=bool)
        for key in keys:
            values = batch[key].to_numpy()
            last &= values == values[-1]
        held = batch[last]
        if not last.all():
            yield batch[~last]
    if held is not None:
        yield held


def _starts(*columns: np.ndarray) -> np.ndarray:
    change = np.zeros(len(columns[0]), dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _individual_modes(fit: Fit, family, y, eta0, z, group, n_groups):
    """Mode, curvature and penalised likelihood of every individual's intercept."""
    precision = 1 / fit.sd_ind**2
    u = np.zeros(n_groups)
    score = SCORES.get(fit.family, lambda *x: family(*x)[1:])
    left, part = np.arange(n_groups), (y, eta0, z, group)  # individuals still on their way, and their rows
    for _ in range(MODE_STEPS):
        at = u[left]
        g, w = score(part[0], part[1] + at[part[3]], fit.aux, part[2])
        grad = np.bincount(part[3], g, len(left)) - precision * at
        move = grad / (np.bincount(part[3], w, len(left)) + precision)
        u[left] = at + np.clip(move, -2.0, 2.0)
        open_ = np.abs(move) >= MODE_STOP
        if not open_.any():
            break
        if open_.mean() < 0.7:
            rows, number = open_[part[3]], np.cumsum(open_) - 1
            left, part = left[open_], (*(x[rows] for x in part[:3]), number[part[3][rows]])
    ll, g, w = family(y, eta0 + u[group], fit.aux, z)
    s = np.bincount(group, w, n_groups) + precision
    return u, s, ll, g, w


def batch_sums(fit: Fit, a: np.ndarray, y, offset, z, weight, keep=None) -> np.ndarray:
    """The vector of a fit without random intercepts: see ``unpack`` for the layout.

    ``a`` is the design with a leading column of ones. ``keep`` masks rows out by weight, which
    is cheaper than copying the others when most rows stay.
    """
    family = FAMILIES[fit.family]
    if fit.flat_scale:
        z = np.zeros(len(y))
    eta = a[:, 1:] @ fit.beta + offset
    k = weight if keep is None else np.where(keep, weight, 0.0)
    ll, g, w = family(y, eta, fit.aux, z)
    if keep is not None:
        ll = np.where(keep, ll, 0.0)
    h = a.T @ (a * (w * k)[:, None])
    total = float(ll @ k) if np.isfinite(ll).all() else -1e300
    parts = [[k.sum(), total, total], (g * k) @ a, h[np.triu_indices(a.shape[1])]]
    for values in _scalar_terms(fit, family, y, eta, z, ll):
        parts.append([float((values * k).sum()) if np.isfinite(values).all() else 0.0])
    return np.concatenate([np.atleast_1d(np.asarray(q, dtype=float)) for q in parts])


def _scalar_terms(fit: Fit, family, y, eta, z, ll) -> list[np.ndarray]:
    """What the family's scalars need, row by row, so that large sums do not cancel."""
    out = []
    if fit.family in SHAPE and fit.family != "student":
        name, _ = SHAPE[fit.family]
        for shift in (-SHAPE_STEP, SHAPE_STEP):
            out.append(family(y, eta, {**fit.aux, name: fit.aux[name] * np.exp(shift)}, z)[0] - ll)
    if fit.family == "student":
        nu, s2 = fit.aux["nu"], np.exp(2 * (fit.aux["gamma"][0] + fit.aux["gamma"][1] * z))
        r2 = (y - eta) ** 2
        q = r2 / (nu * s2)
        share, half = q / (1 + q), nu / 2
        slope, bend = nu_constants(nu)
        logs = half * np.log1p(q)
        out += [slope - logs + (half + 0.5) * share, bend - logs + nu * share - (half + 0.5) * share * (1 - share)]
        pull = (nu + 1) * share - 1
        info = 2 * nu / (nu + 3)
        out += [pull, pull * z, np.full(len(y), info), info * z, info * z * z]
    if fit.family == "gaussian":
        out.append((y - eta) ** 2)
    return out


def plot_sums(fit: Fit, a: np.ndarray, y, offset, z, weight, v, ind_start, plot_start) -> np.ndarray:
    """One vector for each plot of a batch (rows), laid out as in ``unpack``.

    All plots go through the family and the modes of individuals together; only the small cross products
    are taken plot by plot. The third entry is the penalised likelihood at the mode, without determinants.
    """
    family = FAMILIES[fit.family]
    if fit.flat_scale:
        z = np.zeros(len(y))
    eta = a[:, 1:] @ fit.beta + offset + v
    plot_end = np.append(plot_start[1:], len(y))

    def by_plot(values: np.ndarray, starts=plot_start) -> np.ndarray:
        return np.add.reduceat(values, starts)

    if fit.sd_ind > 0:
        group = np.zeros(len(y), dtype=int)
        group[ind_start[1:]] = 1
        group = np.cumsum(group)
        u, s, ll, g, w = _individual_modes(fit, family, y, eta, z, group, len(ind_start))
        eta = eta + u[group]
        first = np.searchsorted(ind_start, plot_start)
        often = weight[ind_start]
        penalty = by_plot(-0.5 * u * u / fit.sd_ind**2 * often, first)
        determinant = by_plot(-0.5 * np.log(fit.sd_ind**2 * s) * often, first)
    else:
        ll, g, w = family(y, eta, fit.aux, z)
        penalty = determinant = 0.0
    wa = a * (w * weight)[:, None]
    h = np.stack([a[lo:hi].T @ wa[lo:hi] for lo, hi in zip(plot_start, plot_end)])
    if fit.sd_ind > 0:
        c = np.add.reduceat(wa, ind_start, axis=0)
        ends = np.append(first[1:], len(ind_start))
        scaled = c / (s * often)[:, None]
        h -= np.stack([c[lo:hi].T @ scaled[lo:hi] for lo, hi in zip(first, ends)])
    total = by_plot(ll * weight)
    total = np.where(np.isfinite(total), total, -1e300)
    up = np.triu_indices(a.shape[1])
    parts = [
        by_plot(weight)[:, None],
        (total + penalty + determinant)[:, None],
        (total + penalty)[:, None],
        np.add.reduceat(a * (g * weight)[:, None], plot_start, axis=0),
        h[:, up[0], up[1]],
    ]
    for values in _scalar_terms(fit, family, y, eta, z, ll):
        summed = by_plot(values * weight)
        parts.append(np.where(np.isfinite(summed), summed, 0.0)[:, None])
    return np.concatenate(parts, axis=1)


def unpack(vec: np.ndarray, p: int) -> dict:
    """Named pieces of a fit's vector; index 0 of ``g`` and ``h`` is the plot intercept."""
    k = (p + 1) * (p + 2) // 2
    h = np.zeros((p + 1, p + 1))
    h[np.triu_indices(p + 1)] = vec[3 + p + 1 : 3 + p + 1 + k]
    h = h + np.triu(h, 1).T
    return {"n": vec[0], "ll": vec[1], "mode": vec[2], "g": vec[3 : 3 + p + 1], "h": h, "extra": vec[3 + p + 1 + k :]}


class PlotEffects:
    """Plot intercepts of many fits as one matrix (fits x plots); a plot that it lacks has effect 0."""

    def __init__(self, plots: Sequence[str], values: np.ndarray):
        self.index = {p: k for k, p in enumerate(plots)}
        self.values = np.column_stack([values, np.zeros(len(values))])

    def some(self, fits: Sequence[int]) -> PlotEffects:
        out = PlotEffects((), np.zeros((0, 0)))
        out.index, out.values = self.index, self.values[list(fits)]
        return out

    def of(self, fit: int, names) -> np.ndarray:
        return self.values[fit, [self.index.get(p, -1) for p in names]]


def _batch(pdf: pd.DataFrame, rows: Rows):
    data = {c: pdf[c].to_numpy(dtype=float) for c in rows.numeric}
    data |= {c: Coded(pdf[c].to_numpy(), levels) for c, levels in rows.factors.items()}
    return data, *(pdf[c].to_numpy(dtype=float) for c in ("__y", "__o", "__z", "__w"))


def _make_partials(fits: Sequence[Fit], rows: Rows):
    """Sums of fits without random intercepts."""

    rows = rows.narrow()

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            data, y, o, z, weight = _batch(pdf, rows)
            mask = pdf["__m"].to_numpy()
            matrices: dict[int, np.ndarray] = {}
            for i, fit in enumerate(fits):
                a = matrices.get(id(fit.design))
                if a is None:
                    x = fit.design.matrix(data, len(pdf))
                    a = matrices[id(fit.design)] = np.column_stack([np.ones(len(pdf)), x])
                inside = (mask >> fit.train) & 1 == 1
                if not inside.any():
                    continue
                if inside.mean() > 0.6:
                    vec = batch_sums(fit, a, y, o, z, weight, None if inside.all() else inside)
                else:
                    vec = batch_sums(fit, a[inside], y[inside], o[inside], z[inside], weight[inside])
                totals[i] = totals[i] + vec if i in totals else vec
        if totals:
            yield pd.DataFrame([(i, "", vec) for i, vec in totals.items()], columns=["fit", "plot", "stats"])

    return partials


def _make_plot_partials(fits: Sequence[Fit], rows: Rows, effects=None):
    """Vectors of each (fit, plot) of a batch, in the order of the plots.

    ``effects`` is a broadcast ``PlotEffects``; without it a column ``__v`` may hold an array for each row.
    """
    rows = rows.narrow()
    groups: dict[tuple, list[int]] = {}
    for i, fit in enumerate(fits):
        groups.setdefault((id(fit.design), fit.train), []).append(i)
    members = list(groups.values())

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ("__plot", "__ind")):
            data, y, o, z, weight = _batch(pdf, rows)
            mask, plot, ind = pdf["__m"].to_numpy(), pdf["__plot"].to_numpy(), pdf["__ind"].to_numpy()
            given = pdf["__v"].to_numpy() if "__v" in pdf else None
            out, made, a = [], None, None
            for same in members:
                fit = fits[same[0]]
                if made is not fit.design:
                    made, a = fit.design, np.column_stack([np.ones(len(pdf)), fit.design.matrix(data, len(pdf))])
                pick = np.flatnonzero((mask >> fit.train) & 1)
                if not len(pick):
                    continue
                part = [a, y, o, z, weight, plot, ind]
                if len(pick) < len(pdf):
                    part = [x[pick] for x in part]
                starts = _starts(part[5])
                sizes = np.diff(np.append(starts, len(pick)))
                for i in same:
                    if given is not None:
                        v = np.array([0.0 if given[k] is None else given[k][i] for k in pick[starts]])
                    else:
                        v = effects.value.of(i, part[5][starts]) if effects is not None else np.zeros(len(starts))
                    vecs = plot_sums(fits[i], *part[:5], np.repeat(v, sizes), _starts(part[5], part[6]), starts)
                    out += [(i, p, vec) for p, vec in zip(part[5][starts], vecs)]
            out.sort(key=lambda row: row[1])
            if out:
                yield pd.DataFrame(out, columns=["fit", "plot", "stats"])

    return partials


def _make_plot_step(fits: Sequence[Fit], previous: bool, effects=None):
    """Add a plot's partial vectors and eliminate its intercept."""

    def finish(i, plot, vec, v, totals, out):
        fit = fits[i]
        p = len(fit.beta)
        q = unpack(vec, p)
        prec = 1 / fit.sd_plot**2
        hvv, gv, hvx = q["h"][0, 0] + prec, q["g"][0] - prec * v, q["h"][0, 1:]
        schur = q["h"][1:, 1:] - np.outer(hvx, hvx) / hvv
        rhs = q["g"][1:] - hvx * gv / hvv
        mode = q["mode"] - 0.5 * prec * v * v
        ll = q["ll"] - 0.5 * prec * v * v - 0.5 * np.log(fit.sd_plot**2 * hvv)
        summed = np.concatenate([[q["n"], ll, mode], rhs, schur[np.triu_indices(p)], q["extra"], [gv * gv / hvv]])
        totals[i] = totals[i] + summed if i in totals else summed
        out.append((i, plot, v, hvv, gv, hvx))

    def plot_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        columns = ["fit", "plot", "v", "hvv", "gv", "vec"]
        for pdf in whole_groups(batches, ("plot",)):
            sums: dict[tuple, np.ndarray] = {}
            given: dict[str, np.ndarray] = {}
            for i, plot, vec in zip(pdf["fit"], pdf["plot"], pdf["stats"]):
                key = (i, plot)
                sums[key] = sums[key] + vec if key in sums else np.asarray(vec)
            if previous:
                given = dict(zip(pdf["plot"], pdf["v"]))
            out: list = []
            for (i, plot), vec in sums.items():
                if effects is not None:
                    v = float(effects.value.of(i, [plot])[0])
                else:
                    v = given.get(plot)
                    v = 0.0 if v is None else float(v[i])
                finish(i, plot, vec, v, totals, out)
            yield pd.DataFrame(out, columns=columns)
        if totals:
            yield pd.DataFrame([(i, None, 0.0, 0.0, 0.0, s) for i, s in totals.items()], columns=columns)

    return plot_step


def _sum_by_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add up the totals of the tasks; rows of plots pass."""
    totals: dict[int, np.ndarray] = {}
    for pdf in batches:
        whole = pdf["plot"].isna().to_numpy()
        for i, raw in zip(pdf["fit"][whole], pdf["vec"][whole]):
            vec = np.frombuffer(raw)
            totals[i] = totals[i] + vec if i in totals else vec
        yield pdf[~whole]
    yield pd.DataFrame(
        [(i, None, 0.0, 0.0, v.tobytes()) for i, v in totals.items()], columns=["fit", "plot", "hvv", "gv", "vec"]
    )


# --- driver side ------------------------------------------------------------------------


def _add_vectors(df: DataFrame, column: str) -> dict[int, np.ndarray]:
    """Element-wise sum per fit, combined on the map side; the driver gets one vector per fit."""
    rows = (
        df.select("fit", F.posexplode(column).alias("pos", "value"))
        .groupBy("fit", "pos")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    sizes: dict[int, int] = {}
    for r in rows:
        sizes[r["fit"]] = max(sizes.get(r["fit"], 0), r["pos"] + 1)
    out = {i: np.zeros(k) for i, k in sizes.items()}
    for r in rows:
        out[r["fit"]][r["pos"]] = r["value"]
    return out


def _solve(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
    inverse = np.linalg.pinv(h / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
    return inverse @ g, inverse


def _scale_and_shape(nu, extra, slope, bend, move) -> tuple[np.ndarray, float]:
    """Joint scoring step of the t scale (two terms) and log nu.

    Scale and tail weight trade off against each other; stepping in turn would crawl along that
    ridge. The cross term is the expected information of the t law.
    """
    score, info = extra[:2], np.array([[extra[2], extra[3]], [extra[3], extra[4]]])
    if np.linalg.matrix_rank(info) < 2:  # constant z: a single scale
        info, score = info[:1, :1], score[:1]
    k = len(score)
    if bend < 0:
        cross = -2 * nu / ((nu + 1) * (nu + 3)) / (2 * nu / (nu + 3)) * np.array([extra[2], extra[3]])[:k]
        joint = np.block([[info, cross[:, None]], [cross[None, :], np.array([[-bend]])]])
        if np.linalg.eigvalsh(joint)[0] > 0:
            step = np.linalg.solve(joint, np.append(score, slope))
            score_move, move = step[:k], float(np.clip(step[k], -1.0, 1.0))
        else:
            score_move = np.linalg.solve(info, score)
    else:
        score_move = np.linalg.solve(info, score)
    return np.append(np.clip(score_move, -0.7, 0.7), np.zeros(2 - k)), move


def _tune(fit: Fit, extra: np.ndarray, n: float) -> tuple[dict, float]:
    """Next family scalars and the likelihood gain expected from the move.

    ``theta`` follows a parabola through the likelihoods at the neighbouring values, log ``nu`` its derivatives;
    the t scale takes a scoring step; the Gaussian scale has a closed form.
    """
    aux, gain = dict(fit.aux), 0.0
    if fit.family in SHAPE:
        name, (lo, hi) = SHAPE[fit.family]
        if fit.family == "student":
            slope, bend = extra[0], extra[1]
        else:
            down, up = extra[0], extra[1]
            slope, bend = (up - down) / (2 * SHAPE_STEP), (up + down) / SHAPE_STEP**2
        move = float(np.clip(-slope / bend, -1.0, 1.0)) if bend < 0 else float(np.sign(slope)) * 0.5
        if fit.family == "student":
            scale, move = _scale_and_shape(fit.aux["nu"], extra[2:], slope, bend, move)
            gain += float(abs(extra[2:4] @ scale))
            aux["gamma"] = tuple(float(c) for c in np.asarray(aux["gamma"]) + scale)
        new = float(np.exp(np.clip(np.log(aux[name]) + move, lo, hi)))
        if new != aux[name]:  # at a bound nothing more is to be gained
            gain += abs(slope * move)
        aux[name] = new
    if fit.family == "gaussian":
        aux["sigma"] = float(np.sqrt(max(extra[0], 1e-300) / n))
        gain += 2 * n * math.log(aux["sigma"] / fit.aux["sigma"]) ** 2
    return aux, gain


def _between(old: dict, new: dict, t: float) -> dict:
    """Family scalars a share ``t`` of the way from old to new."""
    out = {}
    for k in old:
        if k == "gamma":
            out[k] = tuple(float(a + t * (b - a)) for a, b in zip(old[k], new[k]))
        else:
            out[k] = float(old[k] * (new[k] / old[k]) ** t)
    return out


def fit_fixed(rows: Rows, fits: Sequence[Fit], max_iter: int = 25, tol: float = 1e-6) -> list[Fit]:
    """Fisher scoring of many fits; a fit whose likelihood falls goes back and halves its step.

    A fit is done when the next step promises less than ``tol`` units of log-likelihood, which
    bounds the distance to the optimum in standard errors whatever the number of rows. The last step is
    still taken; likelihood and covariance are those of the point before it.
    """
    rows = rows.plain
    fits = [replace(f, converged=False, error=None) for f in fits]
    settled: dict[int, tuple] = {}
    for iteration in range(1, max_iter + 1):
        active = [i for i, f in enumerate(fits) if not f.converged and f.error is None]
        if not active:
            break
        job = _make_partials([fits[i] for i in active], rows)
        sums = _add_vectors(rows.df.mapInPandas(job, "fit int, plot string, stats array<double>"), "stats")
        for k, i in enumerate(active):
            fit = fits[i]
            if k not in sums:
                fits[i] = replace(fit, error="empty training set")
                continue
            q = unpack(sums[k], len(fit.beta))
            best = settled.get(i)
            if best is not None and not q["ll"] >= best[0] - 1e-9 * (1 + abs(best[0])):
                _, beta, aux, delta, new_aux, t = best
                t /= 2
                settled[i] = (*best[:5], t)
                fits[i] = replace(
                    fit,
                    beta=beta + t * delta,
                    aux=_between(aux, new_aux, t),
                    iterations=iteration,
                    converged=t < 1e-4,
                )
                continue
            delta, inverse = _solve(q["h"][1:, 1:], q["g"][1:])
            aux, tuned = _tune(fit, q["extra"], q["n"])
            done = float(q["g"][1:] @ delta) + tuned < max(tol, 1e-13 * abs(q["ll"]))
            settled[i] = (q["ll"], fit.beta, fit.aux, delta, aux, 1.0)
            fits[i] = replace(
                fit,
                loglik=q["ll"],
                n=int(q["n"]),
                covariance=inverse,
                beta=fit.beta + delta,
                aux=fit.aux if done else aux,
                converged=bool(done),
                iterations=iteration,
            )
    return fits


def score_sets(rows: Rows, tasks: Sequence[tuple[Fit, int]], kind: str) -> list[dict]:
    """Out-of-sample scores of every (fit, test set) pair in one pass.

    ``kind="binary"`` gives Brier and LogLoss, ``kind="size"`` MSE, MAE and the variance of the
    response in the test set.
    """
    rows = rows.plain
    narrow = rows.narrow()
    usable = [(i, f, t) for i, (f, t) in enumerate(tasks) if f.error is None]

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            data, y, o, _, weight = _batch(pdf, narrow)
            mask = pdf["__t"].to_numpy()
            matrices: dict[int, np.ndarray] = {}
            for i, fit, test in usable:
                inside = (mask >> test) & 1 == 1
                if not inside.any():
                    continue
                x = matrices.get(id(fit.design))
                if x is None:
                    x = matrices[id(fit.design)] = fit.design.matrix(data, len(pdf))
                vec = binary_or_size(LINK_MEAN[fit.family](x[inside] @ fit.beta + o[inside]), y[inside], weight[inside], kind)
                totals[i] = totals[i] + vec if i in totals else vec
        if totals:
            yield pd.DataFrame([(i, v) for i, v in totals.items()], columns=["fit", "stats"])

    sums = _add_vectors(rows.df.mapInPandas(partials, "fit int, stats array<double>"), "stats")
    return named_scores(sums, len(tasks), kind)


def binary_or_size(pred: np.ndarray, obs: np.ndarray, weight: np.ndarray, kind: str) -> np.ndarray:
    """Rows, two summed losses, and the sums of the response and its square."""
    if kind == "binary":
        p = np.clip(pred, LOGLOSS_EPSILON, 1 - LOGLOSS_EPSILON)
        losses = (obs - pred) ** 2 @ weight, -(obs * np.log(p) + (1 - obs) * np.log1p(-p)) @ weight
    else:
        losses = (obs - pred) ** 2 @ weight, np.abs(obs - pred) @ weight
    return np.array([weight.sum(), *losses, obs @ weight, (obs * obs) @ weight])


def named_scores(sums: dict[int, np.ndarray], n_tasks: int, kind: str) -> list[dict]:
    names = ("Brier", "LogLoss") if kind == "binary" else ("MSE", "MAE")
    out = []
    for i in range(n_tasks):
        if i not in sums:
            out.append({})
            continue
        n, first, second, total, squares = sums[i]
        scores = {names[0]: first / n, names[1]: second / n}
        if kind == "size" and n > 1:
            scores["PseudoR2"] = 1 - scores["MSE"] / max((squares - total * total / n) / (n - 1), 1e-300)
        out.append(scores)
    return out


def _schur(vec: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, right side and family terms of a fit whose plot intercepts are eliminated."""
    k = p * (p + 1) // 2
    h = np.zeros((p, p))
    h[np.triu_indices(p)] = vec[3 + p : 3 + p + k]
    return h + np.triu(h, 1).T, vec[3 : 3 + p], vec[3 + p + k :]


def _effects_pass(rows: Rows, fits: Sequence[Fit], effects: PlotEffects | None):
    """One pass: the summed vector of each fit, and for each the (plots, hvv, gv, hvx) of its plots.

    A plot is finished by the task that holds it, unless some plot is split over tasks; then partial vectors meet by
    plot first. Totals are added by fit on Spark, so the driver reads one vector for each fit and one short row
    for each (fit, plot), of which there are at most ``BROADCAST_CELLS``. Fits without intercepts of individuals read
    the rows merged over individuals.
    """
    if rows.flat is not None:
        sums, plots = {}, {}
        for source, flat in ((rows.flat, True), (replace(rows, flat=None), False)):
            chosen = [i for i, f in enumerate(fits) if (f.sd_ind == 0) == flat]
            if chosen:
                some = None if effects is None else effects.some(chosen)
                found, of_plots = _effects_pass(source, [fits[i] for i in chosen], some)
                sums |= {chosen[k]: v for k, v in found.items()}
                plots |= {chosen[k]: v for k, v in of_plots.items()}
        return sums, plots
    shared = None if effects is None else rows.df.sparkSession.sparkContext.broadcast(effects)
    partials = _make_plot_partials(fits, rows, shared)
    step = _make_plot_step(fits, False, shared)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.drop(columns="v").assign(vec=[np.asarray(x, float).tobytes() for x in pdf["vec"]])

    schema = "fit int, plot string, hvv double, gv double, vec binary"
    if rows.split:
        met = rows.df.mapInPandas(partials, "fit int, plot string, stats array<double>")
        met = met.repartition(task_count(met), "plot").sortWithinPartitions("plot")
        done = met.mapInPandas(lambda batches: packed(step(batches)), schema)
    else:
        done = rows.df.mapInPandas(lambda batches: packed(step(partials(batches))), schema)
    found = done.repartition("fit").mapInPandas(_sum_by_fit, schema).toArrow().to_pandas()
    if shared is not None:
        shared.unpersist()
    whole = found["plot"].isna()
    sums = {int(i): np.frombuffer(raw) for i, raw in zip(found["fit"][whole], found["vec"][whole])}
    plots = {}
    for i, part in found[~whole].groupby("fit"):
        hvx = np.frombuffer(b"".join(part["vec"])).reshape(len(part), -1)
        plots[int(i)] = (part["plot"].to_numpy(), part["hvv"].to_numpy(), part["gv"].to_numpy(), hvx)
    return sums, plots


def fit_effects(
    rows: Rows, fits: Sequence[Fit], max_iter: int = 8, tol: float = 1e-4
) -> tuple[list[Fit], DataFrame]:
    """Joint scoring of fixed effects and plot intercepts at given variances.

    Returns the fits and the table ``fit, plot, v`` of plot effects of the last pass.
    """
    if rows.n_plots * len(fits) > BROADCAST_CELLS:
        return _fit_effects_by_table(rows, fits, max_iter, tol)
    fits, found = fit_effects_together(rows, fits, None, max_iter, tol)
    return fits, effects_table(rows.df.sparkSession, found)


Effects = dict[str, float]


def effects_table(spark, found: Sequence[Effects]) -> DataFrame:
    """``fit, plot, v`` of plot effects held by the driver."""
    flat = [(i, plot, v) for i, effects in enumerate(found) for plot, v in effects.items()]
    return spark.createDataFrame(flat, "fit int, plot string, v double")


def _matrix(found: Sequence[Effects]) -> PlotEffects:
    plots = sorted(set().union(*found)) if found else []
    return PlotEffects(plots, np.array([[e.get(p, 0.0) for p in plots] for e in found]).reshape(len(found), len(plots)))


def fit_effects_together(
    rows: Rows, fits: Sequence[Fit], begin: Sequence[Effects] | None, max_iter: int = 8, tol: float = 1e-4
) -> tuple[list[Fit], list[Effects]]:
    """Joint scoring of many fits in shared passes, each from its own plot effects.

    A fit whose penalised likelihood falls goes back and halves its step. One that is done, has no training rows or
    no finite likelihood leaves the passes and touches no other. Likelihood and covariance are those of
    the point before the last step.
    """
    fits = [replace(f, converged=False, error=None) for f in fits]
    effects = [dict(e) for e in begin] if begin is not None else [{} for _ in fits]
    settled: dict[int, tuple] = {}
    for iteration in range(1, max_iter + 1):
        active = [i for i, f in enumerate(fits) if not f.converged and f.error is None]
        if not active:
            break
        current = [effects[i] for i in active]
        sums, plots = _effects_pass(rows, [fits[i] for i in active], _matrix(current) if any(current) else None)
        for k, i in enumerate(active):
            fit = fits[i]
            if k not in sums or not np.isfinite(sums[k]).all():
                fits[i] = replace(fit, error="empty training set" if k not in sums else "no finite likelihood")
                continue
            vec, best = sums[k], settled.get(i)
            if best is not None and not vec[2] >= best[0] - 1e-9 * (1 + abs(best[0])):
                _, beta, aux, from_effects, delta, new_aux, moves, t = best
                t /= 2
                settled[i] = (*best[:7], t)
                effects[i] = {p: from_effects.get(p, 0.0) + t * m for p, m in moves.items()}
                fits[i] = replace(fit, beta=beta + t * delta, aux=_between(aux, new_aux, t), iterations=iteration, converged=t < 1e-4)
                continue
            h, rhs, extra = _schur(vec, len(fit.beta))
            delta, inverse = _solve(h, rhs)
            aux, tuned = _tune(fit, extra[:-1], vec[0])
            done = float(rhs @ delta) + float(extra[-1]) + tuned < max(tol, 1e-13 * abs(vec[1]))
            names, hvv, gv, hvx = plots[k]
            moves = dict(zip(names.tolist(), ((gv - hvx @ delta) / hvv).tolist()))
            settled[i] = (vec[2], fit.beta, fit.aux, effects[i], delta, aux, moves, 1.0)
            effects[i] = {p: effects[i].get(p, 0.0) + m for p, m in moves.items()}
            fits[i] = replace(
                fit,
                loglik=float(vec[1]),
                n=int(vec[0]),
                covariance=inverse,
                beta=fit.beta + delta,
                aux=aux,
                converged=bool(done),
                iterations=iteration,
            )
    return fits, effects


def _fit_effects_by_table(
    rows: Rows, fits: Sequence[Fit], max_iter: int = 8, tol: float = 1e-4
) -> tuple[list[Fit], DataFrame]:
    """``fit_effects`` with the plot effects as a checkpointed table, joined to the rows in each pass."""
    fits, effects = list(fits), None
    for iteration in range(1, max_iter + 1):
        source = rows.df
        if effects is not None:
            by_fit = F.map_from_entries(F.collect_list(F.struct("fit", "v")))
            packed = cut_lineage(
                effects.groupBy(F.col("plot").alias("__plot"))
                .agg(by_fit.alias("__by_fit"))
                .select(
                    "__plot",
                    F.array(
                        *[F.coalesce(F.try_element_at("__by_fit", F.lit(i)), F.lit(0.0)) for i in range(len(fits))]
                    ).alias("__v"),
                )
            )
            if rows.n_plots * len(fits) <= BROADCAST_CELLS:
                source = source.join(F.broadcast(packed), "__plot", "left")
            else:
                source = cluster(source.join(packed, "__plot", "left"))
        partial = source.mapInPandas(
            _make_plot_partials(fits, rows), "fit int, plot string, stats array<double>"
        )
        if effects is not None:
            partial = partial.join(packed.withColumnsRenamed({"__plot": "plot", "__v": "v"}), "plot", "left")
        partial = partial.repartition(task_count(partial), "plot").sortWithinPartitions("plot")
        step = cut_lineage(
            partial.mapInPandas(
                _make_plot_step(fits, effects is not None),
                "fit int, plot string, v double, hvv double, gv double, vec array<double>",
            )
        )
        sums = _add_vectors(step.filter(F.col("plot").isNull()), "vec")
        deltas, change = {}, 0.0
        for i, fit in enumerate(fits):
            if i not in sums or fit.error is not None or not np.isfinite(sums[i]).all():
                fits[i] = replace(fit, error=fit.error or ("empty training set" if i not in sums else "no finite likelihood"))
                deltas[i] = np.zeros(len(fit.beta))
                continue
            p, vec = len(fit.beta), sums[i]
            h = np.zeros((p, p))
            k = p * (p + 1) // 2
            h[np.triu_indices(p)] = vec[3 + p : 3 + p + k]
            h = h + np.triu(h, 1).T
            rhs, extra = vec[3 : 3 + p], vec[3 + p + k :]
            delta, inverse = _solve(h, rhs)
            aux, tuned = _tune(fit, extra[:-1], vec[0])
            gain = float(rhs @ delta) + float(extra[-1]) + tuned
            done = gain < max(tol, 1e-13 * abs(vec[1]))
            change = max(change, 0.0 if done else 1.0)
            deltas[i] = delta
            fits[i] = replace(
                fit,
                loglik=float(vec[1]),
                n=int(vec[0]),
                covariance=inverse,
                beta=fit.beta + delta,
                aux=aux,
                converged=bool(done),
                iterations=iteration,
            )
        moves = F.create_map(
            *[x for i, d in deltas.items() for x in (F.lit(i), F.array(*[F.lit(float(b)) for b in d]))]
        )
        carried = F.aggregate(
            F.zip_with("vec", F.element_at(moves, F.col("fit")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
        )
        effects = step.filter(F.col("plot").isNotNull()).select(
            "fit", "plot", (F.col("v") + (F.col("gv") - carried) / F.col("hvv")).alias("v")
        )
        if change == 0.0:
            break
    return fits, effects
