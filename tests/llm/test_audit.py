"""The graph's audit sees what is missed in small groups, and a search that fails it thrice is replaced by brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sievework.llm import graph


def test_audit_counts_points_as_well_as_links(spark):
    rng = np.random.default_rng(4)
    hot, rare = np.eye(32)[0], np.linalg.qr(rng.normal(size=(32, 32)))[0][1:21]
    x = np.concatenate([hot + 0.01 * rng.normal(size=(100, 32)), np.repeat(rare, 2, axis=0) + 0.01 * rng.normal(size=(40, 32))])
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    points = graph.unit_vectors(frame, "vec_id", "embedding").select(F.col("k").alias("id"), "v", F.lit(1).cast("long").alias("n")).cache()
    found = spark.createDataFrame([(i, None, 99 if i < 100 else 0) for i in range(140)], "id long, other long, links long")
    assert graph.audit(points, found, 0.95) < 0.9
    assert graph.audit(points, graph._compared(points, 140, 0.95), 0.95) == 1.0


def test_a_search_that_keeps_failing_is_replaced_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 16)), 4, axis=0) + 0.02 * rng.normal(size=(120, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    tries = []

    def blind(points, rows, threshold, beam, overlap):
        tries.append(beam)
        return points.select("id", F.lit(None).cast("long").alias("other"), F.lit(0).cast("long").alias("links"))

    monkeypatch.setattr(graph, "_searched", blind)
    monkeypatch.setattr(graph, "BLOCK", 50)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = graph.near_vectors(frame).toPandas().set_index("vec_id").loc[range(len(x))]
    assert len(tries) == graph.ATTEMPTS and got.n_links.tolist() == true.tolist()
    assert got.component_id.tolist() == [i // 4 * 4 for i in range(120)]


def brute(rows):
    """(n_links, component_id) by row number; rows: (vec_id, vector)."""
    n = len(rows)
    x = np.array([v if v is not None and any(v) else [np.nan] * 16 for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    head = list(range(n))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(int(i)), root(int(j))
        head[max(a, b)] = min(a, b)
    ids = [[rows[j][0] for j in range(n) if root(j) == root(i) and rows[j][0] is not None] for i in range(n)]
    return [(int(near[i].sum()), min(ids[i], default=None)) for i in range(n)]


def test_rows_of_null_and_repeated_keys_link_like_others(spark):
    base, other, third = [1.0, 0.2] + [0.0] * 14, [0.0] * 15 + [1.0], [0.0] * 8 + [1.0] + [0.0] * 7
    rows = [(None, base), (5, base), (5, None), (6, other), (None, None), (None, third), (9, base), (6, other), (None, third), (4, [2.0, 0.4] + [0.0] * 14), (7, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in graph.near_vectors(frame).collect()), key=str)
    want = [(k, n, k if n == 0 else c, k == (k if n == 0 else c)) for (k, _), (n, c) in zip(rows, brute(rows), strict=True)]
    assert got == sorted(want, key=str) and got.count((None, 3, 4, False)) == 1


def test_shards_are_split_until_they_fit(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(150, 16))
    x = np.concatenate([c + 0.06 * rng.normal(size=(10, 16)) for c in centres] + [np.eye(16)[0] + 0.01 * rng.normal(size=(200, 16))])
    monkeypatch.setattr(graph, "SHARD_ROWS", 60)
    monkeypatch.setattr(graph, "BLOCK", 150)
    monkeypatch.setattr(graph, "MOST_CENTRES", 24)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    points = graph.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").select(F.col("k").alias("id"), "v", F.lit(1).cast("long").alias("n"))
    placed = graph._sharded(points, len(x), 2, 0.95)
    sizes = sorted(r["count"] for r in placed.groupBy("shard").count().collect())
    assert len(sizes) > 16 and sum(n > 150 for n in sizes) <= 4  # the group that no centres can split
    assert placed.select("id").distinct().count() == len(x) and placed.where("not array_contains(shards, shard)").count() == 0
    assert placed.groupBy("id").agg((F.count("*") == F.first(F.size("shards"))).alias("ok")).where("not ok").count() == 0
    got = graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").loc[range(len(x))]
    want = brute(rows)
    assert got.n_links.sum() >= 0.98 * sum(n for n, _ in want) and (got.n_links <= [n for n, _ in want]).all()
    assert (got.component_id == [c for _, c in want]).mean() >= 0.98
