"""Whole reviews, from patches made of documents to decisions after one recheck, with their SQL.

Each document is a patch: its lines are comments of a Python file, and a snippet that tells its case is added below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.run import ReviewRun
from ..operators.scanners import Registry
from .registry import ORACLES, QUERIES, table

#: Added lines, status, rules, whether a recheck was tried and used up, by case.
CASES = [
    ('cursor.execute("SELECT * FROM t WHERE id=" + user_id)', "BLOCK", "B003", 0),
    ('import os\nos.system("deploy " + branch)', "BLOCK", "B002", 0),
    ('key = "AKIA' + 'IOSFODNN7EXAMPLE"', "BLOCK", "B001", 0),
    ("total = 1", "PASS", "P001", 0),
    ("def broken(: eval(x)", "NEEDS_REVIEW", "N001,N008", 1),
    ('password = "correct-horse-battery-9A"', "NEEDS_REVIEW", "N004,N008", 1),
    ("total = 2  # the quality reviewer timed out", "NEEDS_REVIEW", "N001,N006,N007,N008", 1),
    ("total = 3  # in a file that is no Python", "NEEDS_REVIEW", "N002", 0),
    ("total = 4  # in a hunk that declares another length", "FAILED", "F001", 0),
    ('ticket = "TICKET-"', "NEEDS_REVIEW", "N004,N008", 1),
    ("fail = 1", "NEEDS_REVIEW", "N001,N008", 1),
    ('import os\nos.popen("ls")', "NEEDS_REVIEW", "N005,N008", 1),
]


def _case() -> F.Column:
    return (F.col("doc_id") % len(CASES)).cast("int")


class Tickets:
    """A scanner of a user's own: ticket numbers are secrets here; it fails on a line that says so."""

    def eval(self, line) -> Iterator[tuple]:  # noqa: ANN001
        if line["content"] == "fail = 1":
            raise ValueError(line["content"])
        for hit in re.findall(r"TICKET-[0-9]+", line["content"]):
            yield line["line_key"], "TICKET", hit, "E2", "suspected"


def patches(docs: DataFrame) -> DataFrame:
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\\p{L}\\x20\\n]", "")
    case = _case()
    snippet = F.replace(F.get(F.array(*[F.lit(c[0]) for c in CASES]), case), F.lit("TICKET-"), F.concat(F.lit("TICKET-"), F.col("doc_id").cast("string")))
    body, added = F.split(letters, "\n"), F.split(snippet, "\n")
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.when(case == 7, ".txt").otherwise(".py"))
    counts = F.concat(F.lit("@@ -1,"), F.size(body).cast("string"), F.lit(" +1,"), (F.size(body) + F.size(added) + (case == 8).cast("int")).cast("string"), F.lit(" @@"))
    lines = F.concat(F.array(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), counts), F.transform(body, lambda x: F.concat(F.lit(" # "), x)), F.transform(added, lambda x: F.concat(F.lit("+"), x)))
    return docs.select(F.col("doc_id").alias("review_id"), F.array_join(lines, "\n").alias("raw_diff"))


def outcomes(docs: DataFrame) -> DataFrame:
    """Recorded outcomes of the two reviewing agents."""
    agents = F.explode(F.array(F.lit("security-scanner"), F.lit("quality-reviewer"))).alias("agent_id")
    late = (_case() == 6) & (F.col("agent_id") == "quality-reviewer")
    rows = docs.select("doc_id", agents)
    return rows.select(F.col("doc_id").alias("review_id"), "agent_id", F.when(late, "failed").otherwise("success").alias("status"), F.when(late, "TIMEOUT").alias("error_code"), F.lit(False).alias("repair_exhausted"))


def review_run(spark: SparkSession, sf_dir: str) -> ReviewRun:
    docs, extra = table(spark, sf_dir, "documents"), Registry()
    extra.add("tickets", "detect_secret", Tickets)
    return ReviewRun(patches(docs), outcomes(docs), extra=extra)


_TOLD = ", ".join(f"({n}, '{status}', '{rules}', {tried})" for n, (_, status, rules, tried) in enumerate(CASES))
QUERIES["k02_whole_run"] = lambda spark, d: review_run(spark, d).decisions.select("review_id", "status", F.array_join("rule_ids", ",").alias("rule_ids"), "attempts", "exhausted", "exit_code")
ORACLES["k02_whole_run"] = f"SELECT doc_id AS review_id, status, rule_ids, tried::INT AS attempts, tried = 1 AS exhausted, CASE status WHEN 'PASS' THEN 0 WHEN 'BLOCK' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 3 END AS exit_code FROM documents JOIN (VALUES {_TOLD}) t(n, status, rule_ids, tried) ON n = doc_id % {len(CASES)}"
QUERIES["x02_scanner_masks"] = lambda spark, d: review_run(spark, d).masked.where("redacted").select("review_id", "content")
ORACLES["x02_scanner_masks"] = f"SELECT doc_id AS review_id, CASE doc_id % {len(CASES)} WHEN 2 THEN 'key = \"<REDACTED:AWS_ACCESS_KEY:' || left(sha256('AKIA' || 'IOSFODNN7EXAMPLE'), 12) || '>\"' WHEN 5 THEN 'password = \"<REDACTED:SUSPECTED_VALUE:' || left(sha256('correct-horse-battery-9A'), 12) || '>\"' ELSE 'ticket = \"<REDACTED:TICKET:' || left(sha256('TICKET-' || doc_id), 12) || '>\"' END AS content FROM documents WHERE doc_id % {len(CASES)} IN (2, 5, 9)"
