"""Toxicity scores from a weighted lexicon.

Text is lower-cased and folded: accents, look-alike letters of other scripts, digits and signs that stand
for letters become plain letters (``l``, ``1``, ``!`` and ``|`` fall together), invisible characters go. An
Aho-Corasick automaton finds the entries, which are words or stems: an entry begins where a word
begins, and a word also ends there. A match inside an exception phrase does not count. The summed
weights of the matches and their density over the text's length give the score through a logistic curve.

The lexicon is learned from labels: words and word beginnings of 4 to 8 letters found in at least ``SUPPORT`` toxic
documents (a quarter of them if there are fewer than four times as many), whatever share that is, so a language with
few toxic documents gets its entries too. The weight is the logarithm of the ratio of the two rates of occurrence a
word; it has to reach ``RATIO``, and the likelihood ratio of the two document counts ``GAIN``. An entry may well
occur in clean documents: there it occurs once, and sum and density tell. Learning uses at most ``SAMPLE``
labelled documents, those with the smallest hashed ids, and only ids with crc32(id) mod 5 <> 0. Scoring sees the text
alone.

Null and empty texts get the score of a text without a match. Without labels of both kinds the score is 0.
Rows that repeat an id are scored each; a null id is not held out. Very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

SAMPLE = 20_000
SUPPORT = 3
RATIO = 8.0
GAIN = 10.0
STEMS = range(4, 9)

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "s", "ø": "o", "æ": "a", "đ": "d", "ł": "i",
}
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
# Innocent phrases that hold a word of abuse.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "sore loser", "pond scum", "idiot proof")


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isalpha():
            out[code] = base
    out |= {ord(k): v for k, v in LOOK_ALIKES.items()}
    for code, letter in list(out.items()):
        out[code] = DIGITS.get(letter, letter)
    out |= {ord(k): v for k, v in DIGITS.items()}
    hidden = [*range(0x300, 0x370), *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xAD, 0xFEFF]
    return out | dict.fromkeys(hidden)


_FOLD = _table()
_SIGN = re.compile(r"[@$!|]+(?=[^\W\d_])")
_SIGN_FOLD = {ord(k): v for k, v in SIGNS.items()}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    text = (text or "").lower().translate(_FOLD)
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: m[0].translate(_SIGN_FOLD), text)
    return text


def entries_of(text: str) -> Counter:
    """How often a folded text has each of its words, marked by a full stop, and of their beginnings."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text)).items():
        out[word + "."] += n
        for k in STEMS:
            if len(word) > k:
                out[word[:k]] += n
    return out


@dataclass
class Lexicon:
    """Folded entries (a word ends in a full stop, a stem does not), exceptions, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] | None = None

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry.rstrip("."), (len(entry.rstrip(".")), entry.endswith("."), weight))
        for phrase in {fold(p) for p in self.exceptions}:
            if phrase not in found:
                found.add_word(phrase, (len(phrase), True, 0.0))
        found.make_automaton()
        return found

    def totals(self, matcher, text: str | None) -> tuple[float, float]:
        """(sum of weights, sum for a hundred characters) of a text."""
        text = fold(text)
        if not text or not len(matcher):
            return 0.0, 0.0
        hits, spared = [], []
        for last, (size, whole, weight) in matcher.iter(text):
            first, end = last - size + 1, last + 1
            if first and text[first - 1].isalpha() or whole and end < len(text) and text[end].isalpha():
                continue
            (hits if weight else spared).append((first, end, weight))
        total = sum(w for b, e, w in hits if not any(x <= b and e <= y for x, y, _ in spared))
        return total, 100 * total / len(text)

    def score(self, total: float, density: float) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + self.curve[1] * math.log1p(total) + self.curve[2] * math.log1p(density)
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), np.log1p(x)])
    beta = np.zeros(3)
    ridge = np.diag([0.0, 0.5, 0.5])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - ridge @ beta
        bend = design.T @ (design * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1]), float(beta[2])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.max("toxic") > 0).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    train = stored(texts.join(F.broadcast(chosen), "__id").select("text", "toxic"), "toxicity-sample")
    rows = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = rows.get(True, 0), rows.get(False, 0)
    out = Lexicon(exceptions=exceptions)
    if not n1 or not n0:
        return out

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, list[int]] = {"": [0, 0, 0, 0]}  # documents and occurrences, clean and toxic; "" for all words
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for entry, n in entries_of(fold(text)).items():
                    for name in (entry, "") if entry.endswith(".") else (entry,):
                        row = count.setdefault(name, [0, 0, 0, 0])
                        row[label] += 1
                        row[2 + label] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*count.values()))],
            names=["entry", "d0", "d1", "c0", "c1"],
        )

    parts = train.mapInArrow(counted, "entry string, d0 long, d1 long, c0 long, c1 long")
    each = stored(parts.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "c0", "c1")]), "toxicity-entries")
    words = each.where("entry = ''").first()
    weight = F.log((F.col("c1") + 0.5) / (words["c1"] + 1)) - F.log((F.col("c0") + 0.5) / (words["c0"] + 1))

    def fits(k, n, p):  # log-likelihood of k in n at the rate p
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)

    d0, d1 = F.col("d0"), F.col("d1")
    apart = fits(d1, F.lit(n1), d1 / n1) + fits(d0, F.lit(n0), d0 / n0)
    gain = 2 * (apart - fits(d0 + d1, F.lit(n0 + n1), (d0 + d1) / (n0 + n1)))
    telling = each.where(f"entry <> '' and d1 >= {min(SUPPORT, max(2, n1 // 4))}").where(d1 / n1 > d0 / n0)
    telling = telling.select("entry", weight.alias("weight"), gain.alias("gain"))
    good = telling.where((F.col("weight") >= math.log(RATIO)) & (F.col("gain") >= GAIN)).collect()
    for r in sorted(good, key=lambda r: (-r["gain"], len(r["entry"]), r["entry"])):
        if not any(r["entry"][:k] in out.weights for k in STEMS if k < len(r["entry"])):
            out.weights[r["entry"]] = r["weight"]

    lexicon = out

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            totals = [lexicon.totals(matcher, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[0] for t in totals], pa.float64()), pa.array([t[1] for t in totals], pa.float64()), batch.column(1)],
                names=["total", "density", "toxic"],
            )

    points = train.mapInArrow(measured, "total double, density double, toxic boolean").collect()
    out.curve = _fit_curve(np.array([[p[0], p[1]] for p in points]), np.array([float(p[2]) for p in points]))
    return out


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with toxicity_score; every other column as it is."""
    docs = docs.drop("toxicity_score")
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            scores = [lexicon.score(*lexicon.totals(matcher, t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*columns, "toxicity_score"])

    return docs.mapInArrow(run, docs.withColumn("toxicity_score", F.lit(0.0).cast("double")).schema)
