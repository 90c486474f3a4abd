"""The top-k search against all inner products: ties, odd vectors, repeated ids, wide numbers, many small blocks."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sievework.llm import topk


def plain(rows, k=5):
    """rows: (vec_id, vector); the k best of every row whose id is divisible by 50."""
    kept = [(i, v, [math.floor(256.0 * float(x)) for x in w]) for i, (v, w) in enumerate(rows) if w is not None and all(x is not None and math.isfinite(x) for x in w)]
    out = []
    for i, v, w in kept:
        if v is None or v % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(w, x)), u is None, u or 0) for j, u, x in kept if j != i)
        out += [(v, n + 1, None if none else u, -s) for n, (s, none, u) in enumerate(scored[:k])]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def answer(df, **more):
    return Counter(tuple(r) for r in topk.top_k(df, topk.F.col("vec_id") % 50 == 0, **more).collect())


@pytest.mark.parametrize("block", [7, 4096])
def test_ties_and_random(spark, block):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]
    assert answer(frame(spark, rows), block=block) == plain(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (1, [1.0, 2.0, 3.0]), (2, []), (250, []), (0, [1.0, 2.0]), (None, [5.0, 5.0]), (None, [0.0, 0.0]), (300, [-0.001, 0.003]), (3, [1e6, -1e6])]
    assert answer(frame(spark, rows)) == plain(rows)


def test_extra_columns_and_empty(spark):
    df = frame(spark, [(0, [1.0]), (7, [2.0])]).selectExpr("*", "1 AS score", "2 AS rank", "'x' AS id", "3 AS row", "4 AS slice")
    assert answer(df) == Counter([(0, 1, 7, 256 * 512)])
    assert topk.op13_topk(frame(spark, [])).count() == 0
    assert topk.op13_topk(frame(spark, [(50, [1.0])])).count() == 0


def test_wide_numbers_are_exact(spark):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) * 10 ** draw.choice([0, 3, 6]) for _ in range(4)]) for i in range(120)]
    assert answer(frame(spark, rows)) == plain(rows)


def test_beyond_a_long(spark):
    out = topk.op13_topk(frame(spark, [(0, [1e30]), (1, [1e30]), (2, [-1e30])])).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (2, -(2**63))]


def test_reading_stops_early():
    """One query that a few vectors answer leaves the lists after their first stretch."""
    n, width = 4096, 8
    numbers = np.random.default_rng(1).integers(-3, 4, (n, width)).astype(np.int32)
    numbers[:5] = 200
    block = topk.Block(n, width, np.arange(n).tobytes(), np.zeros(n, np.bool_).tobytes(), np.arange(n).tobytes(), numbers.tobytes())
    asked = topk.Block(1, width, np.array([-1]).tobytes(), np.zeros(1, np.bool_).tobytes(), np.array([-1]).tobytes(), np.full((1, width), 9, np.int32).tobytes())
    depths, topk.DEPTHS = topk.DEPTHS, (1 / 8,)
    try:
        best = [[]]
        topk.nra(asked, block, best, 5)
    finally:
        topk.DEPTHS = depths
    assert best == [[(-200 * 9 * width, False, i) for i in range(5)]]


def test_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert Counter(tuple(r) for r in topk.op13_topk(df).collect()) == plain(rows)
