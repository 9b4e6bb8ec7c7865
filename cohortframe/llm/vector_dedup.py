"""Links between nearly parallel vectors by an inverted file with product-quantised residuals.

Vectors of one label (and length) are compared; a pair is linked if the cosine in double precision
is at least ``COSINE``. Equal vectors become one representative with a count first.

Unit vectors are assigned to the nearest of ``sqrt(n)`` coarse centroids, and the residual is coded in
eight subspaces of up to 256 centroids. Cosine c means distance d = sqrt(2 - 2c) between unit vectors, so

* a query probes every list whose dividing plane against its own list is at most d away: a partner can be in
  no other list;
* with the quantisation error e(y) stored beside the codes, a partner y has a table-lookup distance of at
  most d + e(y); the rest are skipped;
* what is left is compared exactly.

Neither step loses a pair, however the centroids were fitted. They are fitted on a bounded sample
(``SAMPLE`` vectors with the smallest hashed ids); every vector is indexed. A list of a label is cut into
blocks of about ``BLOCK`` indexed vectors times ``BLOCK`` queries, each block pair a group of its own. A group
returns the number of links of each query and a star for each of its connected parts, never the pairs.

Vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with
nothing. Rows that repeat a vec_id are separate vectors with one id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import stored

COSINE = 0.98
SAMPLE = 40_000
MAX_LISTS = 4_096
SUBSPACES = 8
BLOCK = 3_000


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec: the components as float64 bytes, null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
            end = np.cumsum(size)
            good = np.isfinite(flat)
            bad = np.append(0, np.cumsum(~good))
            some = np.append(0, np.cumsum(np.where(good, flat != 0, False)))
            ok = (bad[end] == bad[end - size]) & (some[end] > some[end - size])
            raw = [flat[e - n : e].tobytes() if k else None for e, n, k in zip(end, size, ok)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["vec_id", "label", "vec"]
            )

    narrow = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    )
    return narrow.mapInArrow(run, "vec_id long, label long, vec binary")


def _kmeans(points: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Plain k-means from evenly spaced points; empty centroids stay where they were."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        of = _nearest(points, centres)
        count = np.bincount(of, minlength=k)
        total = np.stack([np.bincount(of, points[:, d], k) for d in range(points.shape[1])], 1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    norm = (centres**2).sum(1) / 2
    for k in range(0, len(points), 2_000):
        out[k : k + 2_000] = (norm - points[k : k + 2_000] @ centres.T).argmin(1)
    return out


class Model:
    """Coarse centroids and the codebooks of the residuals, for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.coarse = _kmeans(unit, min(lists, len(unit)))
        self.apart = _square_distances(self.coarse)
        residual = unit - self.coarse[_nearest(unit, self.coarse)]
        self.parts = np.array_split(np.arange(unit.shape[1]), min(SUBSPACES, unit.shape[1]))
        self.books = [_kmeans(residual[:, p], min(256, len(unit))) for p in self.parts]

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        decoded = np.concatenate([b[out[:, k]] for k, b in enumerate(self.books)], 1)
        return out, np.linalg.norm(residual - decoded[:, np.argsort(np.concatenate(self.parts))], axis=1)

    def lookup(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the residuals (rows) to the decoded codes (columns)."""
        out = np.zeros((len(residual), len(codes)), np.float64)
        for k, (p, book) in enumerate(zip(self.parts, self.books)):
            r = residual[:, p]
            table = (r**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * r @ book.T
            out += table[:, codes[:, k]]
        return out


def _stack(raw: pa.Array) -> np.ndarray:
    parts = raw.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    size = np.asarray(pa.compute.binary_length(batch.column(column)))
    for n in np.unique(size):
        yield batch.filter(pa.array(size == n))


_ROWS = "label long, dim long, list long, id long, n long, codes binary, error double, vec binary"


def _assigned(reps: DataFrame, models: dict[int, Model], reach: float, queries: bool) -> DataFrame:
    """An indexed row for each vector or, with ``queries``, one for each list that it has to probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                for batch in _by_length(whole.slice(start, 1_000), "vec"):
                    vec = _stack(batch.column("vec"))
                    model = models[vec.shape[1]]
                    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
                    own = _nearest(unit, model.coarse)
                    n = len(vec)
                    if queries:
                        far = ((unit - model.coarse[own]) ** 2).sum(1)[:, None]
                        d2 = (unit**2).sum(1)[:, None] + (model.coarse**2).sum(1)[None, :] - 2 * unit @ model.coarse.T
                        apart = np.sqrt(np.maximum(model.apart[own], 0))
                        row, where = np.nonzero(d2 - far <= 2 * apart * reach + 1e-9)
                        codes, error = pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.float64())
                    else:
                        row, where = np.arange(n), own
                        code, err = model.codes(unit - model.coarse[own])
                        codes, error = pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("label").take(take),
                            pa.array(np.full(len(row), vec.shape[1], np.int64)),
                            pa.array(where.astype(np.int64)),
                            batch.column("id").take(take),
                            batch.column("n").take(take),
                            codes,
                            error,
                            batch.column("vec").take(take),
                        ],
                        names=["label", "dim", "list", "id", "n", "codes", "error", "vec"],
                    )

    return reps.select("label", "id", "n", "vec").mapInArrow(run, _ROWS)


def _square_distances(x: np.ndarray) -> np.ndarray:
    norm = (x**2).sum(1)
    return norm[:, None] + norm[None, :] - 2 * x @ x.T


def _compare(index: pa.Table, query: pa.Table, model: Model, centre: np.ndarray, cosine: float, reach: float):
    """(id, links, root) for the queries and the indexed vectors of one group that have a link."""
    y, q = _stack(index.column("vec").combine_chunks()), _stack(query.column("vec").combine_chunks())
    y_norm, q_norm = np.linalg.norm(y, axis=1), np.linalg.norm(q, axis=1)
    codes = np.frombuffer(b"".join(index.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
    error = np.asarray(index.column("error").combine_chunks())
    y_id, q_id = np.asarray(index.column("id").combine_chunks()), np.asarray(query.column("id").combine_chunks())
    y_n = np.asarray(index.column("n").combine_chunks())
    ids, place = np.unique(np.concatenate([y_id, q_id]), return_inverse=True)
    y_at, q_at = place[: len(y_id)], place[len(y_id) :]
    root = np.arange(len(ids))
    links = np.zeros(len(q), np.int64)
    for k in range(0, len(q), 128):
        part = slice(k, k + 128)
        near = model.lookup(q[part] / q_norm[part, None] - centre, codes) <= ((reach + error + 1e-6) ** 2)[None, :]
        near &= y_id[None, :] != q_id[part][:, None]
        columns = np.flatnonzero(near.any(0))
        if not len(columns):
            continue
        exact = (q[part] @ y[columns].T) / (q_norm[part, None] * y_norm[None, columns])
        linked = (exact >= cosine) & near[:, columns]
        links[part] = linked @ y_n[columns]
        for i in np.flatnonzero(linked.any(1)):
            met = np.unique(root[np.append(y_at[columns[linked[i]]], q_at[k + i])])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    some = np.flatnonzero(links)
    stars = np.flatnonzero(root != np.arange(len(ids)))
    return (
        np.concatenate([q_id[some], ids[stars]]),
        np.concatenate([links[some], np.zeros(len(stars), np.int64)]),
        np.concatenate([q_id[some], ids[root[stars]]]),
    )


def vector_groups(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    reach = math.sqrt(2 - 2 * cosine) + 1e-7
    table = stored(_prepared(vectors), "vectors")
    valid = table.where("vec is not null and label is not null and vec_id is not null")
    reps = stored(valid.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-reps")
    models: dict[int, Model] = {}
    sizes = reps.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count("*").alias("n")).collect()
    for size in sizes:  # one for each vector length in the table
        some = reps.where(F.octet_length("vec") == size["bytes"]).orderBy(F.xxhash64("id"), "id").limit(sample)
        points = np.stack([np.frombuffer(r[0], np.float64) for r in some.select("vec").collect()])
        lists = min(max(math.isqrt(size["n"]), 1), MAX_LISTS, max(len(points) // 8, 1))
        models[size["bytes"] // 8] = Model(points, lists)
    indexed = _assigned(reps, models, reach, False)
    asked = _assigned(reps, models, reach, True)
    key = ["label", "dim", "list"]
    n_index = indexed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("index_blocks"))
    n_query = asked.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("query_blocks"))
    blocks = stored(n_index.join(n_query, key), "list-blocks")
    wide_index = indexed.join(blocks, key).withColumns(
        {
            "i": F.pmod(F.xxhash64("id"), F.col("index_blocks")),
            "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)),
            "asks": F.lit(False),
        }
    )
    wide_query = asked.join(blocks, key).withColumns(
        {
            "q": F.pmod(F.xxhash64("id"), F.col("query_blocks")),
            "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("index_blocks") - 1)),
            "asks": F.lit(True),
        }
    )
    columns = [*key, "i", "q", "asks", "id", "n", "codes", "error", "vec"]

    def group(found: pa.Table) -> pa.Table:
        asks = found.column("asks")
        index, query = found.filter(pa.compute.invert(asks)), found.filter(asks)
        out = (np.zeros(0, np.int64),) * 3
        if index.num_rows and query.num_rows:
            model = models[found.column("dim")[0].as_py()]
            out = _compare(index, query, model, model.coarse[found.column("list")[0].as_py()], cosine, reach)
        return pa.table(dict(zip(("id", "links", "root"), map(pa.array, out))))

    both = wide_index.select(*columns).unionByName(wide_query.select(*columns))
    met = stored(both.groupBy(*key, "i", "q").applyInArrow(group, "id long, links long, root long"), "vector-links")
    comp = components(met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    count = met.groupBy("id").agg(F.sum("links").alias("links"))
    known = stored(
        reps.join(count, "id", "left").join(comp, "id", "left").select(
            "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "id").alias("component"),
        ),
        "vector-groups",
    )
    out = table.join(known, ["label", "vec"], "left")
    has_id = F.col("vec_id").isNotNull()
    component = F.coalesce(F.when(has_id, F.col("component")), F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce(F.when(has_id, F.col("links")), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
