"""The files of a review: twelve and a manifest for a finished run, two and a manifest for what came in.

Every file is one text, its lists sorted by id, so that reruns give equal bytes. A review's files grow with its patch,
which the byte cap bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assurance, secrets
from ..operators.run import AGENTS, ReviewRun
from . import files, sinks

# The stages that a trace tells, in order, and who acts in them.
STAGES = [("diff", "Diff Intake"), ("secret_boundary", "Security Scanner"), ("diff_analysis", "Diff Analyzer"), ("risk_routing", "Diff Analyzer"), ("security_skills", "Security Scanner"), ("security_review", "Security Scanner"), ("quality_review", "Quality Reviewer"), ("evidence_assurance", "Security Scanner"), ("recheck", "Policy Gate"), ("policy_gate", "Policy Gate")]
# The names of the files.
NAMES = ["input-summary.json", "sanitized-diff.json", "diff-analysis.json", "risk-routing.json", "security-review.json", "quality-review.json", "evidence-validation.json", "gate-decision.json", "model-calls.json", "review.json", "trace.jsonl", "report.md"]
VERSION = "1.0.0"


def _list(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """(review_id, name): a review's rows as JSON texts, in order."""
    columns = sorted(c for c in rows.columns if c != "review_id")
    one = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
    return rows.groupBy("review_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["json"]), ","), F.lit("]")).alias(name))


def _object(reviews: DataFrame, **parts: DataFrame | Column) -> DataFrame:
    """(review_id, content): one JSON object a review of texts that are JSON; what a review has not is null or []."""
    rows, fields = reviews.select("review_id", *[c.alias(f"p_{name}") for name, c in parts.items() if isinstance(c, Column)]), []
    for name, part in sorted(parts.items()):
        if isinstance(part, DataFrame):
            rows = rows.join(part.withColumnRenamed(name, f"p_{name}"), "review_id", "left").withColumn(f"p_{name}", F.coalesce(f"p_{name}", F.lit("[]")))
        fields += [F.concat(F.lit(f'"{name}":'), F.coalesce(F.col(f"p_{name}"), F.lit("null")))]
    return rows.select("review_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}\n")).alias("content"))


def _json(column: Column) -> Column:
    """A column's value as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("review_id", F.lit(name).alias("name"), "content")


def review_files(run: ReviewRun) -> DataFrame:
    """(folder, name, content): the files of every review of a run, its manifest among them; the folder is the review's id."""
    r, gate = run.relations, run.gate
    reviews, version, review = run.reviews, F.lit(f'"{VERSION}"'), _json(F.col("review_id"))
    summary = run.files.select("review_id", "file_id", "old_path", "new_path", "change_type", "language", "additions", "deletions", "is_binary", "exclusion_reason", "content_hash")
    failures = run.scan(run.lines)[1].where("skill = 'detect_secret'").select("review_id", F.lit("failed").alias("skill_status"))
    status = reviews.select("review_id").join(failures, "review_id", "left").fillna("success", ["skill_status"])
    shown, disclosed = secrets.disclosure(run.masked, status)
    lines = shown.select("review_id", "file_path", "line_key", "side", "kind", "content", "content_hash", "redacted", "pos")
    routes = run.routes.select("review_id", "route_id", "category", "severity", "skills", "mandatory", "route_source", "reason")
    finding = gate.finding.select("review_id", "artifact_id", "finding_id", "category", "severity", "status", "evidence_ids", "places")
    decision = run.decisions
    plain = decision.select("review_id", "status", "rule_ids", "actions", "reason", "exit_code", "attempts", "exhausted")
    stages = reviews.select("review_id", "trace_id", F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(a).alias("actor")) for s, a in STAGES])).alias("n", "s"))
    events = stages.select("review_id", F.concat_ws("-", F.col("review_id").cast("string"), F.lit("trace"), F.lpad((F.col("n") + 1).cast("string"), 3, "0")).alias("event_id"), "trace_id", (F.col("n") + 1).alias("sequence"), "s.stage", "s.actor")
    line = F.to_json(F.struct("actor", "event_id", "sequence", "stage", "trace_id"))
    parts = {
        "input-summary.json": _object(reviews, schema_version=version, review_id=review, files=_list(summary, "files", "file_id")),
        "sanitized-diff.json": _object(reviews.join(disclosed.select("review_id", "cloud_safe"), "review_id", "left"), schema_version=version, review_id=review, cloud_safe=_json(F.coalesce("cloud_safe", F.lit(False))), lines=_list(lines, "lines", "pos", "line_key")),
        "diff-analysis.json": _object(reviews, schema_version=version, review_id=review, truncated=_json(F.col("truncated")), unsupported=_json(F.col("unsupported")), hunks=_list(r["hunk"], "hunks", "hunk_id")),
        "risk-routing.json": _object(reviews, schema_version=version, review_id=review, routes=_list(routes, "routes", "route_id"), plan=_list(run.plan, "plan", "skill")),
        "evidence-validation.json": _object(reviews, schema_version=version, review_id=review, issues=_list(gate.issues, "issues", "code", "subject"), conflicts=_list(gate.conflicts, "conflicts", "conflict_id"), canonical_findings=_list(assurance.canonical_findings(gate.finding).drop("identity"), "canonical_findings", "canonical_id")),
        "gate-decision.json": _object(decision, schema_version=version, review_id=review, status=_json(F.col("status")), rule_ids=_json(F.col("rule_ids")), actions=_json(F.col("actions")), reason=_json(F.col("reason")), exit_code=_json(F.col("exit_code"))),
        "model-calls.json": _object(reviews, schema_version=version, review_id=review, outcomes=_list(run.outcomes, "outcomes", "agent_id")),
        "review.json": _object(reviews, schema_version=version, review_id=review, trace_id=_json(F.col("trace_id")), decision=_list(plain, "decision", "status"), findings=_list(finding, "findings", "finding_id")),
        "trace.jsonl": events.groupBy("review_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", line.alias("j")))), lambda x: x["j"]), "\n"), F.lit("\n")).alias("content")),
        "report.md": sinks.markdown_report(decision, r["finding"].distinct()).select("review_id", F.concat("report", F.lit("\n")).alias("content")),
    }
    for (agent, _, _, _), name in zip(AGENTS, ("security-review.json", "quality-review.json")):
        own = r["artifact"].where(F.col("agent_id") == agent)
        mine = own.select("review_id", "artifact_id")
        held = {"artifact": _list(own, "artifact", "artifact_id"), "findings": _list(finding.join(mine, ["review_id", "artifact_id"], "left_semi"), "findings", "finding_id"), "evidence": _list(r["evidence"].join(mine, ["review_id", "artifact_id"], "left_semi"), "evidence", "evidence_id"), "coverage": _list(r["coverage"].join(mine, ["review_id", "artifact_id"], "left_semi"), "coverage", "coverage_id")}
        parts[name] = _object(reviews, schema_version=version, review_id=review, **held)
    rows = reduce(DataFrame.unionByName, [_named(parts[name], name) for name in NAMES])
    told = decision.select("review_id", "status").join(disclosed.select("review_id", "cloud_safe"), "review_id", "left").fillna(False, ["cloud_safe"])
    return files.with_manifest(rows.join(told, "review_id").withColumnRenamed("review_id", "folder"), "status", "cloud_safe")


def ingest_files(run: ReviewRun) -> DataFrame:
    """(folder, name, content): what came in, three events about it, and their manifest."""
    reviews, review = run.reviews, _json(F.col("review_id"))
    lines = run.lines.select("review_id", "file_id", "hunk_id", "ordinal", "kind", "side", "line_number", "content", "pos")
    whole = _object(reviews, schema_version=F.lit(f'"{VERSION}"'), review_id=review, files=_list(run.files.drop("hunk_ids", "seen_hunk_ids", "seen_additions", "seen_deletions"), "files", "file_id"), lines=_list(lines, "lines", "pos", "side"))
    counts = run.files.groupBy("review_id").agg(F.count("*").alias("files"), F.max("changed_lines").alias("changed_lines"))
    facts = whole.join(counts, "review_id", "left").withColumns({"files": F.coalesce("files", F.lit(0)), "changed_lines": F.coalesce("changed_lines", F.lit(0))})
    kinds = [("review_created", F.struct(F.col("review_id"))), ("diff_parsed", F.struct("files", "changed_lines")), ("artifact_persisted", F.struct(F.lit("git-diff.json").alias("artifact"), F.sha2("content", 256).alias("artifact_sha256")))]
    events = [F.to_json(F.struct(F.concat_ws("-", F.col("review_id").cast("string"), F.lit(f"event-{n:03d}")).alias("event_id"), F.lit(kind).alias("event_type"), F.lit(n).alias("sequence"), F.lit("success").alias("status"), details.alias("details"))) for n, (kind, details) in enumerate(kinds, 1)]
    trace = facts.select("review_id", F.lit("trace.jsonl").alias("name"), F.concat(F.concat_ws("\n", *events), F.lit("\n")).alias("content"))
    both = _named(whole, "git-diff.json").unionByName(trace).withColumn("cloud_safe", F.lit(False))
    return files.with_manifest(both.withColumnRenamed("review_id", "folder"), "cloud_safe")
