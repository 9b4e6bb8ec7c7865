"""The training-data operators against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from cohortframe.llm import (  # noqa: E402
    buffers, byte_bpe, components, html_text, line_dedup, near_dedup, packing, quality_rules, token_files, toxicity,
    url_rules, vector_dedup,
)

BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, text string, lang string, source string, n_chars long, n_removed string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEN = "one two three four five six seven eight nine ten"
ODD = [
    (1, TEN + "\nshort", "en", "s", 1, "x"),
    (2, TEN.replace("five", "5") + "\nshort\nown line here", "en", "s", 1, "x"),
    (2, TEN.replace("five", "5") + "\nshort\nown line here", "en", "s", 1, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "s", 0, "x"),
    (5, " \n\t ", "en", "s", 0, "x"),
    (None, "no id here\nshort", "en", "s", 1, "x"),
    (6, LONG, "en", "s", 1, "x"),
    (7, LONG, "en", "s", 1, "x"),
    (8, "Ünï  cödé don't\u00a0 x’s \u2003 y…\n\n\n中文 字", "en", "s", 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def tokenizer(path):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def test_pieces_encode_like_whole_texts():
    from cohortframe.llm.tokens import PieceEncoder

    texts = ["a  b", "é \n\n z", "’ a", " lead", "x.y,z!!  q", "don't-'s'll", "naïve, café; ¡hola! a_b", "ΑΣ, ΑΣ", None, "", "\u3000k ."]
    for path in (BPE, WORD_BPE):
        encoder, whole = PieceEncoder(path), tokenizer(path)
        for text in texts:
            for _, data, offsets in buffers.byte_slices(pa.array([text], pa.string())):
                assert encoder.encode(data, offsets)[0].tolist() == whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BPE, WORD_BPE])
def test_pieces_encode_like_whole_documents(small, path):
    import pyarrow.parquet as pq

    from cohortframe.llm.tokens import PieceEncoder

    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"]).column("text")
    encoder, whole = PieceEncoder(path), tokenizer(path)
    for first, data, offsets in buffers.byte_slices(texts, 50_000):
        ids, row, _, _, sizes = encoder.encode(data, offsets)
        per_row = np.bincount(row, sizes, len(offsets) - 1).astype(int)
        for k, part in enumerate(np.split(ids, np.cumsum(per_row)[:-1])):
            text = texts[first + k].as_py() or ""
            assert part.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_lines_odd_rows(odd, nothing):
    rows = line_dedup.dedup_lines(odd).collect()
    got = Counter((r.doc_id, r.text if r.doc_id not in (6, 7) else len(r.text), r.n_removed) for r in rows)
    assert got[(1, TEN + "\nshort", 0)] == 1
    assert got[(2, "own line here", 2)] == 2  # rows of one id keep the same lines
    assert got[(3, None, 0)] == 1 and got[(4, "", 0)] == 1 and got[(5, " \n\t ", 0)] == 1
    assert got[(None, "no id here", 1)] == 1
    assert got[(6, len(LONG), 0)] == 1 and got[(7, 0, 1)] == 1
    assert line_dedup.dedup_lines(nothing).collect() == []


def test_lines_at_distance_one(spark):
    base = TEN.split()
    texts = {1: base, 2: base[:-1], 3: base + ["more"], 4: base[1:] + ["other"], 5: ["zero", *base[1:]], 6: ["zero", *base[1:-1], "far"]}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(frame).where("n_removed > 0").collect()}
    # 2 has nine words and is compared for equality only; 4 is two edits from all; 6 is one edit from 5.
    assert gone == {3, 5, 6}


def test_lines_one_word_longer_than_an_earlier_short_one(spark):
    nine, words = TEN.rsplit(" ", 1)[0], TEN.split()
    rows = [(1, nine), (2, TEN), (3, nine.replace("five", "5")), (4, " ".join(words[1:])), (5, " ".join(words[::-1])), (6, " ".join(words[:0:-1]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: "" if d == 2 else t for d, t in rows}


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def brute_groups(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_groups_match_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in near_dedup.classes(docs).collect()}
    assert got == brute_groups(texts)


def test_near_groups_of_a_wide_blob(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for d in range(120):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            words[at] = f"x{d}y{at}"
        texts[d] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.classes(frame).collect()}
    want = brute_groups(texts)
    assert sum(got[d] != want[d] for d in texts) <= 1


def test_near_groups_large_buckets_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    base = [f"w{i}" for i in range(100)]
    texts = {d: " ".join([*base[: 100 - d % 40], *[f"z{d}q{k}" for k in range(d % 40)]]) for d in range(80)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.classes(frame).collect()}
    assert got == brute_groups(texts)


def test_near_groups_large_buckets_compared_whole(spark, monkeypatch):
    """Twins at 0.80 to 0.85 among strangers that fill their buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rng = np.random.default_rng(11)
    texts, likeness = {}, []
    for d in range(50):
        at = rng.permutation(200)[:5]
        for k, own in ((0, at[1:3]), (1000, at[3:])):
            words = [f"w{i}" for i in range(200)]
            words[at[0]] = f"x{d}"
            for i in own:
                words[i] = f"x{d}y{i}"
            texts[k + d] = " ".join(words)
        a, b = shingle_set(texts[d]), shingle_set(texts[1000 + d])
        likeness.append(len(a & b) / len(a | b))
    assert sum(0.8 <= x < 0.86 for x in likeness) > 40
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.classes(frame).collect()}
    assert got == brute_groups(texts)


def test_near_groups_of_a_hot_bucket_write_no_pairs(spark):
    """A group in which many pairs are left open by the signatures and few are links: rows follow members."""
    rng = np.random.default_rng(3)
    texts = {}
    for d in range(60):
        words = [f"w{i}" for i in range(200)]
        for at in rng.choice(200, 5, replace=False):
            words[at] = f"x{d}y{at}"
        texts[d] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    low = frame.selectExpr("doc_id doc", "lower(text) low")
    sets = near_dedup.shingle_sets(low)
    signed = near_dedup.signatures(low).selectExpr("doc id", "sig", "total")
    keyed = near_dedup.bands(signed.select("id", "sig")).join(signed, "id")
    groups = keyed.selectExpr("key", "key bucket", "2L side", "id", "id c", "sig", "total")
    found = near_dedup._cross_links(groups, sets, 0.8).collect()
    size = groups.groupBy("key").count().where("count > 1").selectExpr("sum(count - 1) n").first().n
    assert len(found) <= size
    want = brute_groups(texts)
    assert all(want[r.a] == want[r.b] for r in found)
    got = {r.doc_id: r.component_id for r in near_dedup.classes(frame).collect()}
    assert got == want


def test_near_groups_copies_that_repeat_a_line(spark):
    texts = {}
    for d in range(20):
        words = [f"w{d}x{i}" for i in range(150)]
        texts |= {d: " ".join(words), 100 + d: " ".join(words[:-30] + words[-30:] * 50)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.classes(frame).collect()}
    assert got == brute_groups(texts) and set(got.values()) == set(range(20))


def test_shingles_weigh_as_their_bytes():
    texts = ["Ünï a b c d e", "one two", "", "x" * 5_000 + " a b c d", None]
    data = [(t or "").lower() for t in texts]
    (_, raw, offsets), = buffers.byte_slices(pa.array(data), 1_000_000)
    of, _, weight, _, _ = near_dedup.shingles(raw, offsets, near_dedup.weigh_by_length)
    sizes = [(k, sum(len(w.encode()) for w in s)) for k, t in enumerate(texts) for s in weighted_shingles(t)]
    assert sorted(zip(of.tolist(), weight.tolist())) == sorted((k, n.bit_length()) for k, n in sizes)


def weighted_shingles(text):
    return {s: sum(len(w.encode()) for w in s).bit_length() for s in shingle_set(text)}


def weighted_groups(texts):
    """Groups by exact probability Jaccard, from its definition, over all pairs."""
    sets = {d: weighted_shingles(t) for d, t in texts.items()}
    group = {d: {d} for d in texts}
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            common = x.keys() & y.keys()
            if a < b and 2 * len(common) >= max(len(x), len(y)) and common:
                whole = sum(max(x.get(j, 0), y.get(j, 0)) for j in x.keys() | y.keys())
                if sum(x[i] / whole for i in common) >= 0.8 - 1e-12 and group[a] is not group[b]:
                    group[a] |= group[b]
                    for d in group[b]:
                        group[d] = group[a]
    return {d: min(g) for d, g in group.items()}


def test_weighted_near_groups_match_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = np.random.default_rng(23)
    for d in range(40):  # near the threshold, where long and short words decide, and with repeated lines
        words = ["of" if i % 40 < 20 else f"extraordinarily{i}of{d}" for i in range(160)]
        words = [w + str(i) if w == "of" else w for i, w in enumerate(words)]
        lot = range(0, 160) if d % 2 else [i for i in range(160) if i % 40 < 20]
        other = list(words)
        for i in rng.choice(lot, 4, replace=False):
            other[i] = "so"
        texts |= {10**6 + d: " ".join(words), 2 * 10**6 + d: " ".join(other + other[-30:] * (d % 3))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.classes(frame, weigh=near_dedup.weigh_by_length).collect()}
    want, plain = weighted_groups(texts), brute_groups(texts)
    assert want != plain
    assert got == want


def test_near_odd_rows(odd, nothing):
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.classes(odd).collect())
    assert got[(7, 6, False)] == 1 and got[(6, 6, True)] == 1 and got[(2, 2, True)] == 2
    assert got[(None, None, True)] == 1 and got[(3, 3, True)] == 1 and got[(4, 4, True)] == 1
    assert near_dedup.classes(nothing).collect() == []
    kept = near_dedup.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = {int(k): float(w) for k, w in zip(rng.integers(1, 2**62, 300), rng.uniform(0.5, 3, 300))}
    keys = list(a)
    b = {k: a[k] for k in keys[:200]} | {int(k): 1.0 for k in rng.integers(1, 2**62, 80)}
    pa_, pb = ({k: w / sum(x.values()) for k, w in x.items()} for x in (a, b))
    exact = sum(
        1 / sum(max(pa_.get(y, 0) / pa_[x], pb.get(y, 0) / pb[x]) for y in pa_.keys() | pb.keys()) for x in pa_.keys() & pb.keys()
    )
    of = np.array([0] * len(a) + [1] * len(b))
    gram = buffers.mix(np.array([*a, *b], np.uint64))
    s = near_dedup.prob_min_hash(of, gram, np.array([*a.values(), *b.values()]), 2)
    assert abs((s[0] == s[1]).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / near_dedup.REGISTERS)


def test_components_of_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[202] == 200 and 300 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_packing_covers_every_token_once(docs, odd, nothing):
    whole = tokenizer(BPE)
    for frame in (docs, odd):
        texts = [(r.doc_id, r.text or "") for r in frame.collect()]
        ids = Counter()
        for d, t in texts:
            ids[d, len(whole.encode(t, add_special_tokens=False).ids) + 1] += 1
        rows = packing.pack(frame, BPE).collect()
        lengths = Counter()
        for r in rows:
            lengths[r.doc_id] += r.length
        assert sum(r.length for r in rows) == sum(n * k for (_, n), k in ids.items())
        windows = {}
        for r in rows:
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.LIMIT
        used = [sum(n for _, n in p) for p in windows.values()]
        padding = sum(packing.LIMIT - n for n in used if n & (n - 1))
        assert padding <= 0.02 * sum(used) + packing.LIMIT * frame.rdd.getNumPartitions()
    one = {r.doc_id: r for r in packing.pack(docs.where("doc_id = 1"), BPE).collect() if r.start == 0}[1]
    text = docs.where("doc_id = 1").first().text
    want = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")[: one.length]
    assert one.ids_crc32 == zlib.crc32(want.tobytes())
    assert packing.pack(nothing, BPE).collect() == []


def test_best_cuts_is_the_cheapest_packing():
    rng = np.random.default_rng(2)
    for _ in range(5):
        total = int(rng.integers(2_000, 4_000))
        at = np.unique(np.append(rng.integers(1, total, 60), total))
        at = np.unique(np.concatenate([at, np.arange(900, total, 900)]))
        price = rng.integers(0, 30, len(at)).astype(float)
        points, cost = [0, *at.tolist()], [0.0]
        for j in range(1, len(points)):
            best = math.inf
            for i in range(j):
                n = points[j] - points[i]
                if n <= 1024:
                    best = min(best, cost[i] + (0 if n & (n - 1) == 0 else 1024 - n))
            cost.append(best + packing.WINDOW + price[j - 1])
        cuts = [0, *packing.best_cuts(total, at, price)]
        paid = sum(
            packing.WINDOW + price[list(at).index(b)] + (0 if (b - a) & (b - a - 1) == 0 else 1024 - b + a) for a, b in zip(cuts, cuts[1:])
        )
        assert abs(paid - cost[-1]) < 1e-6


@pytest.mark.parametrize("planes", ["bytes", "bits"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(3).integers(0, 70_000, 1001).astype(np.uint32)
    assert (token_files.from_planes(token_files.to_planes(ids, 3, planes), len(ids), 3, planes) == ids).all()


def test_token_files(docs, odd, nothing):
    whole = tokenizer(WORD_BPE)
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for planes in ("bytes", "bits"):
        got = sorted(tuple(r) for r in token_files.write_and_read(docs, WORD_BPE, planes=planes).collect())
        assert got == want
    rows = token_files.write_and_read(odd, WORD_BPE).collect()
    assert len(rows) == len(ODD) and sorted(r.start for r in rows)[0] == 0
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert token_files.write_and_read(nothing, WORD_BPE).collect() == []


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_and_decision_list(spark, small, docs, odd, nothing):
    for frame in (docs, odd):
        want = Counter((r.doc_id, *plain_counts(r.text)) for r in frame.collect())
        assert Counter(tuple(r) for r in quality_rules.measures(frame).select("doc_id", *quality_rules.COUNTS).collect()) == want
    labels = spark.createDataFrame([(d, int(d % 3 > 0), 0) for d in range(300)], "doc_id long, quality int, toxic int")
    texts = [(d, ("good words in a calm row of text number " + str(d)) if d % 3 else "a%% b## c$$ d&& e** f## g%% h$$ i&& j## k" + str(d)) for d in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame, labels).collect()}
    assert all(got[d] == (d % 3 > 0) for d in range(300))
    none = labels.limit(0)
    assert quality_rules.judge(odd, none).count() == len(ODD) and quality_rules.judge(nothing, none).collect() == []
    kept = quality_rules.keep_good(odd, none)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7}


def test_byte_bpe(docs, odd, nothing):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    short = odd.where("doc_id is null or doc_id not in (6, 7)")
    for frame in (docs, short):
        want = Counter()
        for r in frame.collect():
            ids = plain.encode_ordinary(r.text or "")
            want[
                r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
            ] += 1
        assert Counter(tuple(r) for r in byte_bpe.encode_decode(frame, ranks, public_tokenizers.PATTERN).collect()) == want
    assert byte_bpe.encode_decode(nothing, ranks, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_cuts_words_into_bytes_without_a_regular_expression(spark):
    every = bytes(range(256)).decode("latin-1")
    words = spark.createDataFrame([(every,), (every[::-1],), ("\n\n",), ("é",)], "word string")
    cut = words.select("word", byte_bpe.fold_merges(byte_bpe.rank_literal({b"\n\n": 1}), F.col("word")).alias("parts"))
    assert "(?" not in cut._jdf.queryExecution().analyzed().toString()
    for r in cut.collect():
        assert r["parts"] == ([r["word"]] if r["word"] == "\n\n" else list(r["word"]))


def test_byte_bpe_finds_places_without_leaving_loops_by_exceptions(spark):
    ranks = {b"aa": 1, b"bc": 2, b"ab": 3, b"aab": 4, b"abc": 0, b"cab": 5, b"\xe9a": 6, b"abca": 7}

    def plain(word):
        parts = [word] if word in ranks or not word else [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            low, i = min((ranks.get(a + b, 99), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low == 99:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [p.decode("latin-1") for p in parts or [b""]]

    random = np.random.default_rng(8)
    words = {"".join(random.choice(list("aabc\xe9"), n)) for n in range(30) for _ in range(20)}
    cut = spark.createDataFrame([(w,) for w in words], "word string").select(
        "word", byte_bpe.fold_merges(byte_bpe.rank_literal(ranks), F.col("word")).alias("parts")
    )
    assert "array_position" not in cut._jdf.queryExecution().analyzed().toString()
    for r in cut.collect():
        assert r["parts"] == plain(r["word"].encode("latin-1"))


def test_toxicity(spark, small, docs, odd, nothing):
    assert toxicity.fold("1D1OT Сlown c1own ｌoser") == "idiot ciown ciown ioser"
    lexicon = toxicity.Lexicon({"idiot.": 3.0, "iow": 2.0, "ciown.": 2.0}, curve=(-2.0, 3.0, 0.5))
    matcher = lexicon.matcher()
    assert lexicon.totals(matcher, "an 1d10t")[0] == 3.0
    assert lexicon.totals(matcher, "idiotic slow")[0] == 0.0  # a word ends where its entry ends; stems begin words
    assert lexicon.totals(matcher, "lower lowest")[0] == 4.0
    assert lexicon.totals(matcher, "the clown fish and a clown")[0] == 2.0
    labels = spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(400)], "doc_id long, quality int, toxic int")
    texts = [(d, f"plain words about thing {d}" + (" you moron" if d % 4 == 0 else "")) for d in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    learned = toxicity.learn(frame, labels)
    got = {r.doc_id: r.toxicity_score for r in toxicity.score(frame, learned).collect()}
    assert all((got[d] >= 0.5) == (d % 4 == 0) for d in range(400))
    scored = toxicity.score(odd, learned)
    assert scored.columns == [*odd.columns, "toxicity_score"] and scored.count() == len(ODD)
    assert toxicity.score(nothing, learned).collect() == []
    assert toxicity.learn(frame, labels.limit(0)).score(9.0, 9.0) == 0.0


def test_toxicity_in_every_language(spark):
    sf_dir = "/root/testdata/sf0.1"
    from cohortframe.llm import queries

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = queries.op9_toxicity(spark, sf_dir).join(labels, "doc_id").join(langs, "doc_id").groupBy("held_out", "lang", "toxic")
    rows = found.agg(F.count("*").alias("n"), F.sum("predicted").alias("hits")).collect()
    held = [r for r in rows if r.held_out]
    toxic = {r.lang: r for r in held if r.toxic}
    assert sum(r.hits for r in toxic.values()) >= 0.9 * sum(r.n for r in toxic.values())
    assert all(r.hits >= 0.85 * r.n for r in rows if r.toxic)  # training rows too: each language has enough of them
    assert sum(r.hits for r in held if not r.toxic) <= 0.01 * sum(r.n for r in held if not r.toxic)


def brute_vectors(rows):
    good = [(i, np.array(e, float), k) for i, e, k in rows if i is not None and e and k is not None and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    links, root = Counter(), {i: i for i, _, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, k) in enumerate(good):
        for j, y, m in good[:a]:
            if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) if i in root else (0, i) for i, _, _ in rows}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.5])], i % 2) for i in range(500)]
    rows += [(600 + i, rows[7][1], 1) for i in range(30)] + [(700, None, 1), (701, [0.0] * 16, 1), (702, [None] + [1.0] * 15, 1)]
    rows += [(703, [float("nan")] * 16, 1), (704, [], 0), (705, rows[0][1], None), (706, [1.0, 2.0], 0), (707, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_groups(frame).collect()}
    want = brute_vectors(rows)
    assert got == want
    assert vector_dedup.vector_groups(frame.limit(0)).collect() == []


def test_urls(spark):
    urls = {
        1: ("HTTPS://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        3: ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        4: ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        5: ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
        6: ("http://x.com/de/#f", "x.com", "/de/", "com/de/", "block"),
        7: ("http://casino-win.net/a", "casino-win.net", "/a", None, "block"),
        8: ("http://alphabets.net/a", "alphabets.net", "/a", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("no scheme", "", "", None, "allow"),
        11: ("x://h?y://org/", "h", "", None, "allow"),
    }
    rows = [(k, v[0], "verdict") for k, v in urls.items()] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = Counter(tuple(r) for r in url_rules.judge(frame).collect())
    assert got == Counter({(k, *v[1:]): 2 for k, v in urls.items()})
    assert url_rules.judge(frame.limit(0)).collect() == []


PAGE = (
    '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Top</header><nav><a href="/a>b">Menu</a></nav>'
    '<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One\n  two<br>three<p>fo<i>u</i>r &copy; &#65;</p>'
    '<div class="comments"><p>I agree</p></div><form>mail</form></article><aside>Side</aside><!-- x --><footer>End</footer></body>'
)


def test_pages(spark):
    assert html_text.main_text(html_text.blocks(PAGE)) == "Head & more One two three four © A"
    shared = "all rights are reserved by the owners of this fine host"
    plain = "<div>{}</div><div>" + shared + "</div>"
    rows = [(1, "http://h.x/1", PAGE, "t"), (2, "http://h.x/2", None, "t"), (3, "http://h.x/3", "", "t"), (None, None, "<p>a", "t")]
    rows += [(k, f"http://H.x/{k}", plain.format(f"a story with number {k}"), "t") for k in (4, 5)]
    rows += [(6, "http://other.x/6", plain.format("another story"), "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(frame).collect()}
    assert got[1][0] == "Head & more One two three four © A" and got[2] == ("", 0) and got[3] == ("", 0) and got[None] == ("a", 1)
    assert got[4][0] == "a story with number 4" and got[5][0] == "a story with number 5"
    assert got[6][0] == "another story " + shared
    assert html_text.extract(frame.limit(0)).collect() == []


STORY = "The storm moved over the coast and left the towns without power for days."
HARD_PAGES = {
    f"<html><head><title>x</title><meta a=b><body><article>{STORY}</article>": STORY,
    f'<nav>m</nav><article class="severe-weather-alert">{STORY}</article>': STORY,
    f'<div class="social-media-story"><article>{STORY}</article></div>': STORY,
    f"<main><h1>Head</h1><p>{STORY}</p><article>card</article></main>": f"Head {STORY} card",
    f"<main><h1>Head</h1><article>{STORY} {STORY} {STORY}</article></main>": f"Head {STORY} {STORY} {STORY}",
    f"<nav><a>Menu</a><article>{STORY}</article>": STORY,
    "<article>E=<math><mi>m</mi>c</math> <object>alt</object><video>fallback</video></article>": "E=mc alt fallback",
    f'<article>{STORY}<div id="comments"><article class="comment">me too</article></div></article>': STORY,
    f"<form><main>{STORY}<form>q</form></main></form>": STORY,
    f'<aside><article>card</article></aside><article>{STORY}</article><div class="related"><article>card</article></div>': STORY,
    '<article>a long enough text <span class="share">x <span>y</span> z</span> b</article>': "a long enough text b",
    f"<article>&#{'9' * 9000}; &#0000000065; 1 < 2 <br/>x<!-->y</article>": "\ufffd A 1 < 2 xy",
}


@pytest.mark.parametrize("page", HARD_PAGES)
def test_pages_with_hard_markup(page):
    assert html_text.main_text(html_text.blocks(page)) == HARD_PAGES[page]


@pytest.mark.parametrize("page", [f'<div class="search-and-rescue"><p>{STORY}</p></div>', f"<head><title>x</title><p>{STORY}"])
def test_pages_without_containers_stay_open(page):
    assert html_text.blocks(page) == [(STORY, False, False)]


BROKEN = ["<b ", "<div>", '<a href="x ', "<a b='c\" ", "<!-- ", "<div class=ad>", "<li><p>", "</", "<", "<nav><article>", "<script>", "&#1"]


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_markup_takes_time_in_proportion(piece):
    """The calls of a run over twice the markup are at most a little more than twice as many."""
    import sys

    def calls(page):
        n = 0

        def count(*_):
            nonlocal n
            n += 1

        sys.setprofile(count)
        try:
            html_text.blocks(page)
        finally:
            sys.setprofile(None)
        return n

    assert calls(piece * 4_000) <= 2.2 * calls(piece * 2_000) + 100
    html_text.blocks(piece * 200_000)


def test_pages_copied_whole_keep_their_text(spark):
    story = " ".join(f"w{k}" for k in range(40))
    foot = " all rights are reserved by the owners of this fine host"
    rows = [(1, "http://h.x/1", f"<div>{story}</div>"), (2, "http://h.x/2", f"<div>{story}</div>")]
    rows += [(k, f"http://g.x/{k}", f"<div>{story}</div><div>{foot}</div>") for k in (3, 4)]
    rows += [(5, "http://g.x/5", f"<div>another story</div><div>{foot}</div>")]
    got = {r.page_id: (r.text, r.n_repeated) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == (story, 0) and got[3] == got[4] == (story, 11) and got[5] == ("another story", 11)


def test_pipeline(spark, small, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= n
        assert stage(spark, odd, small).columns == odd.columns
        assert stage(spark, odd.limit(0), small).collect() == []
    assert corpus_pipeline.run(spark, small).agg(F.sum("length")).first()[0] > 0
