"""Large relations go in slices of whole reviews, with the same results and nothing left of a slice but its rows."""

import os

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from sievework import scratch
from sievework.operators import slices
from sievework.plans import catalogue, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_every_row_is_in_one_slice(spark, kind):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 300).cast(kind).alias("review_id"))
    where = slices.slices([rows, rows.where("review_id is null")], 300)
    assert len(where) == 4
    hits = rows.select(*[F.coalesce(w, F.lit(False)).cast("int").alias(f"c{i}") for i, w in enumerate(where)])
    assert hits.where(" + ".join(hits.columns) + " <> 1").count() == 0
    assert all(100 < n < 500 for n in hits.agg(*[F.sum(c) for c in hits.columns]).first())


def test_few_rows_and_one_review_are_whole(spark):
    rows = spark.range(1000).select(F.lit(7).alias("review_id"))
    assert slices.slices([rows], 1000) == []
    parts = slices.slices([rows], 10)
    assert sorted(rows.where(w).count() for w in parts)[-1] == 1000 and sum(rows.where(w).count() for w in parts) == 1000


@pytest.mark.parametrize("kind", ["long", "string"])
def test_slices_grow_with_the_rows(spark, kind):
    """Each slice runs all jobs of a query again: more rows make larger slices, not more than a few."""
    rows = spark.range(1000).select(F.col("id").cast(kind).alias("review_id"))
    where = slices.slices([rows], 10)
    assert len(where) == slices.MOST and sum(rows.where(w).count() for w in where) == 1000


SLICED = ["p01_w11_decision", "e10_all_issues", "e05_e07_conflicts", "u01_merged_conflicts", "v01_assured_issues", "e08_coverage_gaps", "d02_interval_support", "d03_route_overlap", "d05_c07_location", "d07_verified", "d09_d10_coverage_refs", "a20_markdown", "k01_requests", "d16_finding_lines", "m04_finding_summaries", "k03_k05_scope", "k04_apply", "k04_evidence"]


@pytest.mark.parametrize("name", SLICED)
def test_sliced_query_matches_sql(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "_slices", lambda *_: [F.col("review_id") < 700, F.col("review_id") >= 700])
    before = _tables(spark)
    out = catalogue.QUERIES[name](spark, SF)
    left = _tables(spark) - before
    assert [t.rsplit("-", 1)[0] for t in left] == [name], "a slice left more than its rows"
    assert differences(out, duck(SF), catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["p09_failures", "v01_assured_issues"])
def test_what_needs_no_facts_writes_none(spark, name):
    registry.end_gates()
    before = _tables(spark)
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
    assert _tables(spark) == before


def _tables(spark):
    root = scratch.scratch_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.exists(root) else set()
