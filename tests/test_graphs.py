"""Cycles by joins against the search in one task; joins on intervals against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import cycles, interval


def graphs():
    draw = random.Random(4)
    out = {1: [(i, (i + 1) % 3) for i in range(3)], 2: [(i, (i + 1) % 7) for i in range(7)], 3: [(i, i + 1) for i in range(60)], 4: [(i, (i + 1) % 90) for i in range(90)], 5: [(5, 5), (5, 6), (6, 7)]}
    for n in range(6, 16):
        out[n] = list({(draw.randrange(25), draw.randrange(25)) for _ in range(draw.choice([18, 26, 34, 60]))})
    out[20] = [(i, i + 1) for i in range(4)] + [(4, 0), (4, 5), (5, 6), (6, 5), (2, 7), (7, 8), (8, 2)]
    return out


@pytest.mark.parametrize("limit", [cycles.LINKS, 0])
def test_cycles(spark, limit):
    rows = [(g, f"n{a}", f"n{b}") for g, edges in graphs().items() for a, b in edges]
    links = spark.createDataFrame([*rows, *rows[:5], (1, None, "n0"), (1, "n0", None)], "g long, a string, b string")
    got = sorted((r.g, r.node) for r in cycles.on_cycle(links, "g", limit).collect())
    assert got == sorted((g, n) for g in graphs() for n in cycles.on_cycles([(a, b) for h, a, b in rows if h == g]))


def test_no_links(spark):
    assert cycles.on_cycle(spark.createDataFrame([], "g long, a string, b string"), "g").count() == 0


def spans(spark, n, seed, names=("start_line", "end_line")):
    draw = random.Random(seed)
    rows = [(draw.choice(["x", "x", "y", None]), i, a, a + draw.choice([0, 1, 5, 200, -2])) for i in range(n) for a in [draw.randrange(600)]]
    return rows + [("x", n, None, 4)], spark.createDataFrame(rows + [("x", n, None, 4)], f"k string, {names[0][0]}id int, {names[0]} int, {names[1]} int")


@pytest.mark.parametrize("width", [7, 64])
def test_overlaps(spark, width):
    a, left = spans(spark, 300, 1)
    b, right = spans(spark, 300, 2, ("other_start", "other_end"))
    got = sorted((r.sid, r.oid) for r in interval.overlapping(left, right, ["k"], width=width).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if None not in (x[0], x[2], y[2]) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_first_lines(spark):
    draw = random.Random(8)
    lines = [("h", n, draw.choice(["addition", "context", "context"])) for n in sorted(draw.sample(range(2000), 900))]
    nodes = [("h", i, a, a + draw.choice([0, 3, 40, 1500])) for i in range(300) for a in [draw.randrange(2000)]] + [("h", 0, 3, 9)]
    got = {r.node: r.line_number for r in interval.first_lines(spark.createDataFrame(nodes, "k string, node int, start_line int, end_line int"), spark.createDataFrame(lines, "k string, line_number int, kind string"), ["k"], stretch=50).collect()}
    want = {}
    for i in range(300):
        inside = [(kind, n) for _, n, kind in lines if any(m == i and a <= n <= b for _, m, a, b in nodes)]
        if inside:
            want[i] = min((n for kind, n in inside if kind == "addition"), default=min(n for _, n in inside))
    assert got == want


def test_a_hot_hunk_costs_its_lines(spark):
    """100,000 lines and as many nodes within one hunk: rows of the join follow the pairs, not the product."""
    lines = spark.range(100_000).select(F.lit("h").alias("k"), F.col("id").alias("line_number"), F.when(F.col("id") % 3 == 0, "addition").otherwise("context").alias("kind"))
    nodes = spark.range(100_000).select(F.lit("h").alias("k"), F.col("id").alias("node"), F.col("id").alias("start_line"), (F.col("id") + F.when(F.col("id") % 100 == 0, 50_000).otherwise(5)).alias("end_line"))
    out = interval.first_lines(nodes, lines, ["k"])
    assert out.agg(F.count("*"), F.sum(F.col("line_number") - F.col("node"))).first()[0] == 100_000
    close = spark.range(100_000).select(F.lit("h").alias("k"), F.col("id").alias("other_start"), (F.col("id") + 1).alias("other_end"))
    assert interval.overlapping(nodes.where("node % 100 <> 0").drop("node"), close, ["k"]).count() < 900_000
