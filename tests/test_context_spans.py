"""Context given as spans of lines gives the lines that it gives line by line, and makes none that no finding starts at."""

from compare import differences, duck
from pyspark.sql import functions as F

from sievework.operators import agents
from sievework.plans import catalogue, registry

SF = "/root/testdata/sf0.001"


def test_spans_give_what_lines_give(spark):
    finding = spark.createDataFrame([(1, f"f{n}", "a.py", "h", side, n, n) for n in (-1, 0, 7, 49, 50) for side in ("new", "old")] + [(2, "g", "a.py", "h", "new", 7, 7), (1, "n", "a.py", "h", "new", None, None)], "review_id long, finding_id string, file_path string, hunk_id string, side string, start_line long, end_line long")
    hunk = spark.createDataFrame([(1, "h", "a.py"), (1, "i", "a.py"), (3, "h", "a.py")], "review_id long, hunk_id string, new_path string")
    spans = catalogue._context(hunk)
    assert spans.count() == 3
    lines = spans.select("review_id", "file_path", "hunk_id", "side", F.explode(F.sequence("first", "last")).alias("line")).withColumn("line_ref", F.concat(F.lit("line-"), F.col("line").cast("string")))
    told = [sorted(map(tuple, agents.finding_lines(finding, c).select("review_id", "finding_id", "side", "line_ref").collect())) for c in (lines, spans)]
    assert told[0] == told[1] and len(told[0]) == 3


def test_summaries_over_spans(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry, "_slices", lambda *a: asked.append(a[-1]) or [])
    assert differences(catalogue.QUERIES["m04_finding_summaries"](spark, SF), duck(SF), catalogue.ORACLES["m04_finding_summaries"]) == ""
    assert asked == [1], "a hunk is one row on its way"
