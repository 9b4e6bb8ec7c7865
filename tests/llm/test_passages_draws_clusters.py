"""Passages, resampling and clusters against SQL and brute force, and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twins import compare, duck

from cohortframe.llm import clusters, decontaminate, queries, resample

DOC = "doc_id long, text string, item_id string, n_words string, row long, words string"
ITEM = "item_id long, text string, doc_id string, items string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
RUN = [f"t{i}" for i in range(14)]


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_resampling", "op13_clusters"])
def test_queries_match_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duck(sf_dir)
    assert compare(queries.queries()[name](spark, sf_dir), con, queries.oracle_sql()[name]) == ""


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_passages(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    names |= windows[key]
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


PASSAGES = [
    (1, " ".join(RUN)), (2, " ".join(RUN[2:])), (2, "Only Two"), (10, " ".join(["z"] * 12)), (None, "a b c d e f g"), (3, None),
    (4, ""), (5, "...!"), (9, " ".join(RUN)), (11, "ÄX é k"), (12, "one two three four five six seven eight nine"),
]
DOCS = [
    (1, "x " + " ".join(RUN) + " y " + " ".join(RUN[:9])), (1, "x " + " ".join(RUN)), (2, None), (3, ""), (4, " .,; "),
    (5, " ".join(["z"] * 30)), (6, "ONLY-two!only\ttwo"), (None, "a b c d e f g h a b c d e f g"), (7, LONG + " " + " ".join(RUN)),
    (8, " ".join(RUN[:9])), (9, "Äx é k ÄX É k ÄX é k"), (10, "one two three four five six seven eight nine ten"),
    (11, " ".join(f"q{i}" for i in range(250)) + " " + " ".join(RUN) + " only two"), (12, " ".join([*RUN, *RUN, *RUN])),
]


def found_passages(spark, docs, items, **options):
    frame = spark.createDataFrame([(d, t, "i", "n", 1, "w") for d, t in docs], DOC)
    bench = spark.createDataFrame([(i, t, "d", "x") for i, t in items], ITEM)
    got = decontaminate.contamination(frame, bench, **options)
    return sorted([tuple(r)[:6] for r in got.collect()], key=repr)


def test_passages_match_brute_force_on_odd_rows(spark):
    assert found_passages(spark, DOCS, PASSAGES) == brute_passages(DOCS, PASSAGES)


def test_passages_beyond_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_KEYS", 10)
    assert found_passages(spark, DOCS, PASSAGES) == brute_passages(DOCS, PASSAGES)


def test_passages_of_other_sizes(spark):
    assert found_passages(spark, DOCS, PASSAGES, window=6, shingle=3) == brute_passages(DOCS, PASSAGES, 6)


def test_passages_of_empty_tables(spark):
    assert found_passages(spark, DOCS, []) == brute_passages(DOCS, [])
    assert found_passages(spark, [], PASSAGES) == []
    assert found_passages(spark, [], []) == []


def test_a_common_passage_gives_one_row_a_place(spark):
    docs = [(i, f"own{i} " + " ".join(RUN)) for i in range(300)]
    windows, _ = decontaminate.item_windows(spark.createDataFrame([(i, " ".join(RUN), "d", "x") for i in range(40)], ITEM))
    frame = spark.createDataFrame([(d, t, "i", "n", 1, "w") for d, t in docs], DOC)
    rows = decontaminate.occurrences(frame, windows)
    # Five windows each and the row of the document, whatever the number of items that hold the passage.
    assert rows.count() == 300 * 6


def test_passages_stay_in_the_jvm(spark):
    windows, _ = decontaminate.item_windows(spark.createDataFrame([(1, "a b c", "d", "x")], ITEM))
    frame = spark.createDataFrame([(1, "a b c", "i", "n", 1, "w")], DOC)
    plan = decontaminate.occurrences(frame, windows)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def brute_draw(docs, goal):
    def buckets(text):
        w = words_of(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]

    s, t = [0] * 10_000, [0] * 10_000
    for out, texts in ((s, [x for _, x in docs]), (t, goal)):
        for text in texts:
            for b in buckets(text):
                out[b] += 1
    gain = resample.gains(s, t)
    rows = []
    for k, (doc, text) in enumerate(docs):
        b = buckets(text)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([k, doc, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = [r for r in rows if len(words_of(docs[r[0]][1])) >= 20]
    able.sort(key=lambda r: (-r[4], 2**63 - 1 if r[1] is None else r[1], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted([(r[1], r[2], r[3], r[4], rank.get(r[0])) for r in rows], key=repr)


def test_draw_matches_brute_force_on_odd_rows(spark):
    text = "the quick brown fox jumps over it again and again while nobody looks at all of its many dusty old shoes"
    docs = [(1, text), (1, text), (-5, text + " é Ü"), (None, text), (None, text), (2, None), (3, ""), (4, "?!"), (5, "few words"), (6, LONG)]
    docs += [(100 + i, text + f" {i % 7}" * (i % 5)) for i in range(40)]
    goal = ["nobody looks at old shoes", None, "", "dusty DUSTY é"]
    frame = spark.createDataFrame([(d, t, "i", "n", 1, "w") for d, t in docs], DOC).coalesce(1)
    target = spark.createDataFrame([(1, t, "d", "x") for t in goal], ITEM)
    got = resample.resample(frame, target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_draw(docs, goal)
    empty = spark.createDataFrame([], ITEM)
    got = resample.resample(frame, empty).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_draw(docs, [])
    assert resample.resample(spark.createDataFrame([], DOC), target).collect() == []


@pytest.mark.parametrize("bits", [4, 11])
def test_radix_ranks_match_a_sort(spark, monkeypatch, bits):
    monkeypatch.setattr(resample, "LEAST_BLOCK", 50)
    monkeypatch.setattr(resample, "BLOCKS", 7)
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 3, 1_000), rng.choice([-(2**63), -1, 0, 5, 2**62, 2**63 - 1], 1_000))]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(5).select(F.monotonically_increasing_id().alias("row"), "a", "b")
    frame = frame.persist()
    got = {r["row"]: r["rank"] for r in resample.radix_ranks(frame, ["a", "b"], bits).collect()}
    ordered = sorted((r["a"], r["b"], r["row"]) for r in frame.collect())
    assert got == {row: i + 1 for i, (_, _, row) in enumerate(ordered)}
    same = frame.select("row", F.lit(4).cast("long").alias("a"))
    got = {r["row"]: r["rank"] for r in resample.radix_ranks(same, ["a"], bits).collect()}
    assert got == {row: i + 1 for i, row in enumerate(sorted(got))}


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v).tolist()) for i, v in kept if i is not None)
    centres = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for turn in range(rounds + 1):
        found = [nearest(v) for _, v in kept]
        if turn < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    part = [sum(d for d, c in found if c == j) for j in range(len(centres))]
    return sorted([(i, c, d, part[c], sum(part), name[c]) for (i, _), (d, c) in zip(kept, found)], key=repr)


VECTOR = "vec_id long, embedding array<float>, label int, own string, sums string"


@pytest.mark.parametrize("k, dims", [(8, 4), (25, 3), (1, 4)])
def test_clusters_match_brute_force(spark, k, dims):
    rng = np.random.default_rng(k)
    points = np.round(rng.normal(0, 1, (900, dims)) * 40).astype(np.float32) / 1024  # small whole numbers: many ties
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (901, None), (902, []), (903, [1.0] * (dims + 1))]
    rows += [(904, [None] * dims), (905, [math.nan] * dims), (906, [math.inf] + [0.0] * (dims - 1)), (907, [0.0] * dims)]
    frame = spark.createDataFrame([(i, v, None, "o", "s") for i, v in rows], VECTOR)
    got = clusters.cluster(frame, k=k, dims=dims).collect()
    assert sorted(map(tuple, got), key=repr) == brute_clusters(rows, k, 10, dims, 1024)


def test_clusters_of_few_vectors(spark):
    assert clusters.cluster(spark.createDataFrame([], VECTOR), dims=2).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "o", "s") for i, v in rows], VECTOR)
    assert sorted(map(tuple, clusters.cluster(frame, dims=2).collect()), key=repr) == brute_clusters(rows, 8, 10, 2, 1024)
    with pytest.raises(Exception, match="fit a long"):
        clusters.cluster(spark.createDataFrame([(1, [1e30, 0.0], 1, "o", "s")], VECTOR), dims=2)


def test_search_takes_few_distances():
    rng = np.random.default_rng(1)
    hubs = rng.integers(-90_000, 90_000, (40, 6))
    points = (hubs[rng.integers(0, 40, 4_000)] + rng.integers(-900, 900, (4_000, 6))).astype(np.int64)
    near = clusters.Neighbours(hubs.astype(np.int64))
    own, other, upper, lower, _ = clusters.assign(points, None, near)
    moved = clusters.Neighbours(near.centres + 1, near.centres)
    again = clusters.assign(points, (own, other, upper, lower), moved)
    want = [((points - c) ** 2).sum(1) for c in moved.centres]
    assert np.array_equal(again[0], np.argmin(want, 0))
    assert (again[4] < 0).mean() > 0.99  # kept by their bounds
