"""The rules of every kind of record, asked of the rows that operators make, and of the same rows with one thing bent."""

import pytest
from pyspark.sql import functions as F
from test_bundles import PATCHES

from sievework.functions import constraints
from sievework.operators import patch, recheck
from sievework.operators.run import ReviewRun

BENT = {
    "file": ("additions", "additions + 1", "counts"), "line": ("new_line", "CASE WHEN kind = 'deletion' THEN 1 ELSE new_line END", "numbers"), "location": ("end_line", "start_line - 1", "end_before_start"), "route": ("required_skills", "concat(required_skills, required_skills)", "required_skills_unique"),
    "risk": ("always_on", "array('review_code_quality')", "secret_on"), "evidence": ("file_path", "CAST(NULL AS STRING)", "e3_located"), "finding": ("evidence_ids", "CAST(array() AS ARRAY<STRING>)", "supported"), "coverage": ("error_code", "'X'", "failed_has_code"),
    "artifact": ("input_artifact_ids", "array(artifact_id)", "no_self_parent"), "conflict": ("resolution", "'done'", "resolution"), "decision": ("rule_ids", "array('P001')", "block_has_b"), "masked": ("content", "concat(content, ' ')", "hash"), "plan_entry": ("planned", "false", "skipped"),
    "target": ("locations", "0", "located"), "buckets": ("warning_ids", "blocking_ids", "disjoint"), "diff": ("changed_lines", "changed_lines + 1", "changed"),
}


@pytest.fixture(scope="module")
def records(spark):
    more = [(3, 'diff --git a/z.py b/z.py\n--- a/z.py\n+++ b/z.py\n@@ -1 +1,2 @@\n a\n+password = "correct-horse-battery-9A"')]
    told = [(n, a, "success" if n < 3 else "failed", None if n < 3 else "TIMEOUT", False) for n in (1, 2, 3) for a in ("security-scanner", "quality-reviewer")]
    run = ReviewRun(spark.createDataFrame(PATCHES + more, "review_id long, raw_diff string"), spark.createDataFrame(told, "review_id long, agent_id string, status string, error_code string, repair_exhausted boolean"))
    r, gate = run.relations, run.gate
    listed = lambda rows, c: F.array_sort(F.collect_set(c)).alias(rows)
    none = F.array().cast("array<string>")
    per = lambda rows, c, name, key="artifact_id": rows.groupBy("review_id", key).agg(listed(name, c))
    routes = run.routes.select("review_id", "route_id", F.col("skills").alias("required_skills"), F.lit(1).alias("locations"))
    by_review = routes.groupBy("review_id").agg(listed("route_ids", "route_id"), F.collect_list("required_skills").alias("route_skills"))
    planned = run.plan.where("planned").groupBy("review_id").agg(F.count("*").alias("planned_skill_count"))
    coverage = r["coverage"].join(per(r["coverage_route"], "route_id", "route_ids", "coverage_id"), ["review_id", "coverage_id"], "left").join(per(r["coverage_file"], "file_path", "files_checked", "coverage_id"), ["review_id", "coverage_id"], "left")
    artifact = r["artifact"]
    for rows, c, name in ((r["finding"], "finding_id", "finding_ids"), (r["evidence"], "evidence_id", "evidence_ids"), (r["coverage"], "coverage_id", "coverage_ids"), (r["finding"], "fingerprint", "fingerprints"), (r["lineage"], "parent_id", "input_artifact_ids")):
        artifact = artifact.join(per(rows, c, name), ["review_id", "artifact_id"], "left").withColumn(name, F.coalesce(name, none))
    now = F.lit("2026-01-01").cast("timestamp")
    artifact = artifact.withColumns({"cited_evidence_ids": F.col("evidence_ids"), "model_name": F.lit(None).cast("string"), "prompt_version": F.lit(None).cast("string"), "started_at": now, "completed_at": now})
    buckets = gate.buckets.groupBy("review_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("bucket") == b, F.col("finding_id")))).alias(f"{b}_ids") for b in ("blocking", "review", "warning")])
    buckets = buckets.join(run.decisions.select("review_id", "status"), "review_id").withColumns({"indexed_ids": F.concat("blocking_ids", "review_ids", "warning_ids"), "coverage_complete": F.lit(True), "decided_at": F.lit("2026-01-01T00:00:00Z")})
    diff = run.files.groupBy("review_id").agg(F.sum("additions").alias("total_additions"), F.sum("deletions").alias("total_deletions"), F.max("changed_lines").alias("changed_lines"), F.collect_list(F.col("additions").cast("long")).alias("additions"), F.collect_list(F.col("deletions").cast("long")).alias("deletions"), F.collect_list("file_id").alias("file_ids"), F.flatten(F.collect_list("hunk_ids")).alias("hunk_ids"))
    target = recheck.targets(gate).withColumns({"conflict_ids": F.when(F.col("conflict_id").isNotNull(), F.array("conflict_id")).otherwise(none), "skill_names": F.when(F.col("skill").isNotNull(), F.array("skill")).otherwise(none), "route_ids": F.when(F.col("route_id").isNotNull(), F.array("route_id")).otherwise(none), "locations": F.size("places")})
    conflict = gate.conflicts.unionByName(gate.conflicts.limit(0)).withColumn("resolution", F.lit(None).cast("string"))
    if not conflict.count():  # the runs have none: one as the gate would make it
        conflict = spark.createDataFrame([(1, "x", "contradiction", ["a", "b"], [], False, None)], "review_id long, conflict_id string, type string, finding_ids array<string>, rule_ids array<string>, resolved boolean, resolution string")
    return {
        "file": (run.files, "file_id"), "line": (patch.numbered(run._raw).withColumn("key", F.concat_ws("-", "review_id", "ordinal")), "key"), "location": (r["route_place"].unionByName(r["place"].withColumnRenamed("finding_id", "route_id")), "route_id"), "route": (routes, "route_id"),
        "risk": (by_review.join(planned, "review_id").withColumn("always_on", F.array(*map(F.lit, gate.always_on))), "review_id"), "evidence": (r["evidence"].withColumns({"reproducible": F.col("source") != "llm", "confidence": F.lit(1.0)}), "evidence_id"),
        "finding": (gate.finding.withColumns({"locations": F.size("places"), "confidence": F.col("confidence_pct") / 100}), "finding_id"), "coverage": (coverage.withColumns({c: F.coalesce(c, none) for c in ("route_ids", "files_checked")}), "coverage_id"), "artifact": (artifact, "artifact_id"), "conflict": (conflict, "conflict_id"),
        "decision": (run.decisions, "review_id"), "masked": (run.masked, "line_key"), "plan_entry": (run.plan.withColumn("route_ids", none), "skill"), "target": (target, "target_id"), "buckets": (buckets, "review_id"), "diff": (diff.withColumns({c: none for c in ("change_intents", "affected_symbols", "unsupported_files")}), "review_id"),
    }


def test_records_keep_their_rules(records):
    assert len(records) >= 12 and set(records) == set(BENT)
    for kind, (rows, key) in records.items():
        assert rows.count() > 0, kind
        assert [tuple(v) for v in constraints.violations(rows, key, kind).collect()] == [], kind


def test_bent_records_break_them(records):
    for kind, (column, bent, rule) in BENT.items():
        rows, key = records[kind]
        assert constraints.violations(rows.withColumn(column, F.expr(bent)), key, kind).where(F.col("rule") == rule).count() > 0, kind
