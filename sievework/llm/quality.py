"""Quality by ordinal cumulative-link regression on graded ratings.

A text is a sparse vector of hashed features: its words, the shapes of its words and a few shares (repeats, distinct
words, capitals, marks, lengths). One weight vector, shared by all grades, gives a position on a line; ordered
thresholds cut the line into grades. P(grade >= k) is the logistic function of position minus threshold k; the expected
grade is their sum, and the tail probability from a chosen grade on decides which documents are kept.

Defined cases: null and empty texts have only the constant features; without ratings all positions are 0 and the
thresholds their start values; several ratings of a key, or of texts with equal features, count as their least; repeated
rows give repeated results; an empty table gives an empty table; other columns are ignored. Labels, language, source and key are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, held_out_rows

BUCKETS, SHAPES = 1 << 13, 1 << 10
#: Bound on the rated rows that a model is fitted on.
SAMPLE_ROWS = 20_000
CACHE_WORDS = 300_000
_RUNS = [(re.compile(r"[0-9]+"), "0"), (re.compile(r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\dA_]+"), "a"), (re.compile(r"(.)\1+"), r"\1\1")]
_known: dict[str, tuple[int, int]] = {}


def _shape(word: str) -> str:
    """Runs of digits, capitals and letters as one sign each; marks stay, runs of one mark as two. The whole word counts."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word


def _buckets(word: str) -> tuple[int, int]:
    if len(_known) > CACHE_WORDS:
        _known.clear()
    _known[word] = got = (crc32(_shape(word).encode()) % SHAPES, SHAPES + crc32(word.lower().encode()) % (BUCKETS - SHAPES))
    return got


STATS = 16


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): stats, then shares of shapes, then damped shares of words."""
    words = (text or "").split()
    n = max(1, len(words))
    counts = Counter(words)
    shapes, hashed = np.zeros(SHAPES), {}
    for word, c in counts.items():
        s, h = _known.get(word) or _buckets(word)
        shapes[s] += c
        hashed[h] = hashed.get(h, 0) + c
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    top = max(counts.values(), default=0) / n
    letters = len(text or "")
    lines = (text or "").split("\n")
    stats = [1.0, repeats, repeats > 0.2, len(counts) / n, len(counts) / n < 0.5, top, top > 0.2, n < 20, n < 50, n > 5000, min(1.0, letters / n / 20), len(set(lines)) / len(lines), sum(w.isupper() for w in counts) / max(1, len(counts)), np.log1p(n) / 10, not words, 0.0]
    at = np.flatnonzero(shapes)
    keys = np.fromiter(hashed, np.int64, len(hashed))
    values = np.sqrt(np.fromiter(hashed.values(), np.float64, len(hashed)) / n) * 0.2
    return np.concatenate([np.arange(STATS), STATS + at, STATS + keys]), np.concatenate([np.array(stats, float), np.sqrt(shapes[at] / n), values])


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; threshold k - 1 stands below grade k."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, position: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(position - self.thresholds, -30, 30)))

    def position(self, text: str | None) -> float:
        at, values = features(text)
        return float(self.weights[at] @ values)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, count: int, strength: float = 1e-4, rounds: int = 300) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood; thresholds are a first value and positive gaps."""
    size = STATS + BUCKETS
    shares = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, count)]).clip(0.01, 0.99)
    start = np.log((1 - shares) / shares)
    base = np.concatenate([start[:1], np.log(np.diff(start).clip(0.05))])
    if not rows:
        return OrdinalModel(np.zeros(size), start)
    at, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    x, m, v = np.concatenate([np.zeros(size), base]), 0.0, 0.0
    n = len(rows)
    for step in range(1, rounds + 1):
        cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([x[size : size + 1], np.exp(x[size + 1 :])])), [np.inf]])
        position = np.bincount(owner, x[at] * values, minlength=n)
        high, low = _sigmoid(cuts[grades + 1] - position), _sigmoid(cuts[grades] - position)
        chance = np.maximum(high - low, 1e-9)
        up, down = high * (1 - high) / chance, low * (1 - low) / chance
        slope = np.bincount(at, ((up - down) / n)[owner] * values, minlength=size) + strength * x[:size]
        by_cut = np.array([(down[grades == k].sum() - up[grades == k - 1].sum()) / n for k in range(1, count)])
        after = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([slope, after[:1], after[1:] * np.exp(x[size + 1 :])])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        x = x - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(x[:size], np.cumsum(np.concatenate([x[size : size + 1], np.exp(x[size + 1 :])])))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_quality(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", grades: int = 3, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most sample_rows rated rows (key, grade 0..grades - 1) outside the held-out fold, by a hash of the key."""
    known = ratings.where(F.col(grade).isNotNull() & F.col(key).isNotNull() & ~held_out_rows(key)).groupBy(F.col(key).alias("k")).agg(F.min(grade).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    # A key that repeats stands for one row, that of the least text: the bound is on rows.
    rows = rows.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("k", "t", "y")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([i.astype("<i2").tobytes() for i, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], names=["k", "y", "i", "v"])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        told = rows.mapInArrow(vectors, "k long, y int, i binary, v binary").groupBy("i", "v").agg(F.min("k").alias("k"), F.min("y").alias("y"))
        sample = sorted(told.collect(), key=lambda r: (r.k, bytes(r.i), bytes(r.v)))
    return fit_ordinal([(np.frombuffer(r.i, "<i2").astype(np.int64), np.frombuffer(r.v, "<f4")) for r in sample], np.array([r.y for r in sample], int), grades)


def score_quality(docs: DataFrame, model: OrdinalModel, keep_from: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, expected_grade, score): score is the chance of grade keep_from or better. Narrow."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = np.array([model.tails(model.position(t.as_py())) for t in b.column(2)]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tails.sum(axis=1), pa.float64()), pa.array(tails[:, keep_from - 1], pa.float64())], names=[key, "held_out", "expected_grade", "score"])

    rows = docs.select(F.col(key), held_out_rows(key).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, f"{key} {dict(docs.dtypes)[key]}, held_out boolean, expected_grade double, score double")


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 poor, 1 sound but toxic, 2 sound."""
    return labels.withColumn("grade", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2))


def op8_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_quality(docs, fit_quality(docs, grades_of(labels)))
    return out.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "kept": F.col("score") >= 0.5})
