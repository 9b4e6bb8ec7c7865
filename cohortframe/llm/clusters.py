"""k-means over integer vectors with the Shallot search: exact results, few distances.

Components become ``floor(scale * x)``, so distances and means are exact whole numbers and a run can be repeated
bit by bit. Each vector remembers its nearest and second-nearest centroid, an upper bound of the distance to the first
and a lower bound of the distance to all others. When centroids have moved, the bounds are widened; then

1. a vector whose upper bound stays below the lower bound, or below half the distance from its centroid to that one's
   nearest neighbour, keeps its centroid without any distance;
2. otherwise the distances to both remembered centroids are taken, and the search starts from the closer one, ``c``;
3. a centroid that is nearer than the second must lie within (distance to ``c``) + (distance to the second) of
   ``c``. The neighbours of ``c`` are scanned in the order of their distance to it; each better second shrinks the
   ball, and the scan ends at the first neighbour outside.

Bounds are floating point and only leave out work, with a margin; survivors are compared by squared integer
distance, equal ones by centroid number. State stays with the vectors: a round reads the last round's table and writes
the next without a shuffle, and its tasks add one row of sums for each centroid. The driver sees those added up, k
times the number of components. A round's table goes when the next has been written.

Vectors that are null, of another length, or hold null or non-finite components are left out. Rows that repeat a vec_id
are vectors of their own; equal hashes are ordered by components. A vector without vec_id is clustered and never a
start. With fewer vectors than centroids there are as many centroids as vectors to start from; an empty table, or
one without any vec_id, gives no rows. A scaled component beyond 2**27 raises, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import discard, stored_at

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
LIMIT = 1 << 27
PART = 4_096
_STATE = "vec_id long, vec binary, own int, other int, upper double, lower double, distance long, sums array<long>"


class Neighbours:
    """Centroids of a round with the order and distances of each one's neighbours, and how far each has moved."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None):
        self.centres = centres
        k = len(centres)
        apart = np.stack([np.sqrt(squared(centres, c).astype(float)) for c in centres]) if k else np.zeros((0, 0))
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centres - before) ** 2).sum(1).astype(float))
        self.moved = moved
        # The farthest move among all other centroids.
        top = np.argsort(-moved)[:2]
        self.others_moved = np.full(k, moved[top[0]] if k else 0.0)
        if k:
            self.others_moved[top[0]] = moved[top[1]] if k > 1 else 0.0


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.einsum("ij,ij->i", gap, gap)


def _margin(x: np.ndarray) -> np.ndarray:
    return 1e-9 * x + 1e-6


def assign(points: np.ndarray, state: tuple[np.ndarray, ...] | None, near: Neighbours, exact: bool = False):
    """(own, other, upper, lower, distance) of each vector; distance is -1 where bounds made it needless."""
    n, k = len(points), len(near.centres)
    if state is None:
        own, other = np.zeros(n, np.int32), np.full(n, 1 if k > 1 else 0, np.int32)
        upper, lower = np.full(n, np.inf), np.zeros(n)
    else:
        own, other, upper, lower = (x.copy() for x in state)
        upper += near.moved[own]
        lower -= near.others_moved[own]
    distance = np.full(n, -1, np.int64)
    if not n:
        return own, other, upper, lower, distance

    def unsure(at: np.ndarray) -> np.ndarray:
        bound = np.maximum(lower[at], near.half[own[at]])
        return at[upper[at] + _margin(upper[at]) >= bound]

    def to_centroid(at: np.ndarray, which: np.ndarray) -> np.ndarray:
        gap = points[at] - near.centres[which]
        return np.einsum("ij,ij->i", gap, gap)

    todo = np.arange(n)
    if not exact:
        todo = unsure(todo)
    distance[todo] = to_centroid(todo, own[todo])
    upper[todo] = np.sqrt(distance[todo].astype(float))
    todo = unsure(todo)
    if k == 1 or not len(todo):
        return own, other, upper, lower, distance
    best, best_d = own[todo], distance[todo]
    second = other[todo]
    second_d = to_centroid(todo, second)
    swap = (second_d < best_d) | ((second_d == best_d) & (second < best))
    best, second = np.where(swap, second, best), np.where(swap, best, second)
    best_d, second_d = np.where(swap, second_d, best_d), np.where(swap, best_d, second_d)
    start, radius = best.copy(), np.sqrt(best_d.astype(float))
    ball = radius + np.sqrt(second_d.astype(float))
    live = np.arange(len(todo))
    first, remembered = start.copy(), second.copy()
    for step in range(k - 1):
        live = live[near.apart[start[live], step] <= ball[live] + _margin(ball[live])]
        if not len(live):
            break
        j = near.order[start[live], step].astype(np.int32)
        fresh = (j != first[live]) & (j != remembered[live])  # both distances are known
        at, j = live[fresh], j[fresh]
        d = to_centroid(todo[at], j)
        wins = (d < best_d[at]) | ((d == best_d[at]) & (j < best[at]))
        closer = ~wins & ((d < second_d[at]) | ((d == second_d[at]) & (j < second[at])))
        w, c = at[wins], at[closer]
        second[w], second_d[w] = best[w], best_d[w]
        best[w], best_d[w] = j[wins], d[wins]
        second[c], second_d[c] = j[closer], d[closer]
        changed = at[wins | closer]
        ball[changed] = radius[changed] + np.sqrt(second_d[changed].astype(float))
    own[todo], other[todo], distance[todo] = best, second, best_d
    upper[todo], lower[todo] = np.sqrt(best_d.astype(float)), np.sqrt(second_d.astype(float))
    return own, other, upper, lower, distance


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and vec (scaled components as int32 bytes) of the vectors that can be clustered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dims)
            good = np.isfinite(flat).all(1)
            whole = np.floor(flat[good] * scale)
            if len(whole) and np.abs(whole).max() > LIMIT:
                raise ValueError("a scaled component is beyond 2**27: squared distances would not fit a long")
            raw = whole.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in raw], pa.binary())],
                names=["vec_id", "vec"],
            )

    narrow = vectors.where(F.size("embedding") == dims).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return narrow.mapInArrow(run, "vec_id long, vec binary")


def _round(state: DataFrame, near: Neighbours, dims: int, first: bool, exact: bool) -> DataFrame:
    """The vectors with their new state, then one row of sums (components, count, distances) for each centroid."""
    k = len(near.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "vec", "own", "other", "upper", "lower", "distance", "sums"]
        sums = np.zeros((k, dims + 2), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                batch = whole.slice(at, PART)
                n = batch.num_rows
                points = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(n, dims).astype(np.int64)
                old = None if first else tuple(np.asarray(batch.column(i)) for i in range(2, 6))
                own, other, upper, lower, distance = assign(points, old, near, exact)
                order = np.argsort(own, kind="stable")
                edge = np.flatnonzero(np.diff(own[order], prepend=-1))
                met = own[order][edge]
                sums[met, :dims] += np.add.reduceat(points[order], edge, axis=0)
                sums[met, dims] += np.bincount(own, minlength=k)[met]
                sums[met, dims + 1] += np.add.reduceat(distance[order], edge)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *map(pa.array, (own, other, upper, lower, distance)),
                     pa.nulls(n, pa.list_(pa.int64()))],
                    names=names,
                )
        some = np.flatnonzero(sums[:, dims])
        m = len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(some.astype(np.int32)), pa.nulls(m, pa.int32()),
             pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()),
             pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=names,
        )

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, dims: int) -> np.ndarray:
    rows = state.where("sums is not null").select("own", F.posexplode("sums").alias("i", "x"))
    out = np.zeros((k, dims + 2), object)
    for own, i, x in rows.groupBy("own", "i").agg(F.sum("x")).collect():
        out[own, i] = x
    return out


def starts(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hash of their id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = kept.where("vec_id is not null").select(name.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    return np.array([np.frombuffer(r["vec"], "<i4").astype(np.int64) for r in chosen])


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for every vector that is kept."""
    spark = vectors.sparkSession
    state, folder = stored_at(integer_vectors(vectors, dims, scale), "integer-vectors")
    centres = starts(state, k, seed)
    k = len(centres)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not k:
        return spark.createDataFrame([], schema)
    before = None
    for turn in range(rounds + 1):
        rows = state if turn == 0 else state.where("sums is null").drop("sums")
        done, written = stored_at(_round(rows, Neighbours(centres, before), dims, turn == 0, turn == rounds), "cluster-round")
        discard(spark, folder)
        state, folder = done, written
        sums = _sums(state, k, dims)
        if turn < rounds:
            before, centres = centres, centres.copy()
            for c in np.flatnonzero(sums[:, dims] > 0):
                centres[c] = [x // sums[c, dims] for x in sums[c, :dims]]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    total = int(sum(sums[:, dims + 1]))
    facts = [(c, int(sums[c, dims + 1]), total, names[c]) for c in range(k)]
    table = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    found = state.where("sums is null").select("vec_id", F.col("own").alias("cluster"), "distance")
    return found.join(table, "cluster").select(*[c.split()[0] for c in schema.split(", ")])
