"""Messages between a manager and its workers: correlation, digests, control messages, deliveries, packages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CONTROL_BYTES = 4096
# Marks of failure in a command's output, and of an empty object.
FAILURE_MARKS = r"(?i)access\s*denied|insufficient\s+permissions|unable\s+to\s+(?:list|stat)|object\s+does\s+not\s+exist|\bpermission\s+denied\b|authorization\s+failed|invalid\s+access\s+key|signature\s+does\s+not\s+match"
ZERO_BYTES = r"(?i)(?:^|\s)0\s+B(?:\s|$)"


def canonical_json(value: object) -> str:
    """Sorted keys, compact, no NaN, one line feed at the end."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n"


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """Canonical form of a JSON text; null for what is not JSON, repeats a key or holds NaN."""

    def strict(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def one(t: str | None) -> str | None:
        try:
            return canonical_json(json.loads(t, object_pairs_hook=strict))
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(one)


def accepted_commands(result: DataFrame, reject_zero_bytes: bool = False) -> DataFrame:
    """Results (returncode, stdout, stderr) with return code 0 and no mark of failure."""
    text = F.concat_ws("\n", "stdout", "stderr")
    bad = (F.col("returncode") != 0) | text.rlike(FAILURE_MARKS)
    return result.where(~(bad | text.rlike(ZERO_BYTES) if reject_zero_bytes else bad))


#: Columns in which a delivery and its assignment must agree, and an assignment and its request.
DELIVERY_KEYS = ["review_id", "trace_id", "parent_task_id", "role", "attempt", "input_sha256", "context_sha256"]
REQUEST_KEYS = ["review_id", "trace_id", "parent_task_id", "input_sha256"]


def _differing(left: DataFrame, right: DataFrame, key: str, columns: list[str], unknown: str, **more: F.Column) -> DataFrame:
    """(key, fault): the first fault of each left row: unknown, a differing column, or a condition of both (d and a)."""
    both = left.alias("d").join(right.alias("a"), F.col(f"d.{key}") == F.col(f"a.{key}"), "left")
    fault = F.when(F.col(f"a.{key}").isNull(), unknown)
    for c in columns:
        fault = fault.when(~F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}")), f"{c.upper()}_MISMATCH")
    for name, wrong in more.items():
        fault = fault.when(F.coalesce(wrong, F.lit(False)), name)
    return both.select(F.col(f"d.{key}"), fault.alias("fault")).where("fault is not null")


def correlate(delivery: DataFrame, assignment: DataFrame) -> DataFrame:
    """(task_id, fault): deliveries without an assignment, that differ from it, came too late, or may not claim an analysis."""
    return _differing(delivery, assignment, "task_id", DELIVERY_KEYS, "UNASSIGNED", LATE=F.col("d.finished_at") > F.col("a.deadline_at"), CALLS=F.col("d.model_calls") != 1, BLOCKED=F.col("d.status") == "BLOCKED")


def correlate_request(assignment: DataFrame, request: DataFrame) -> DataFrame:
    """(task_id, fault): assignments whose request is unknown or another one, or that end after it."""
    named = request.withColumnRenamed("root_task_id", "parent_task_id")
    return _differing(assignment.withColumn("review", F.col("review_id")), named.withColumn("review", F.col("review_id")), "review", REQUEST_KEYS, "UNREQUESTED", LATE=F.col("d.deadline_at") > F.col("a.deadline_at"))


def evidence_hash(role: F.Column, summary: F.Column, line_refs: F.Column, confidence: F.Column, ref: F.Column, sha256: F.Column) -> F.Column:
    """Digest of what a worker's evidence says and of what it read, in canonical form."""
    told = F.struct(confidence.alias("confidence"), F.struct(ref.alias("ref"), sha256.alias("sha256")).alias("input_artifact"), line_refs.alias("line_refs"), role.alias("role"), summary.alias("summary"))
    return F.sha2(F.concat(F.to_json(told, {"ignoreNullFields": "false"}), F.lit("\n")), 256)


def worker_evidence(task: DataFrame, draft: DataFrame) -> DataFrame:
    """Evidence of deliveries: one row a draft, or one of the summary where there is none.

    task: (task_id, role, summary, ref, sha256); draft: (task_id, place, claim, line_refs, confidence).
    """
    rows = task.join(draft, "task_id", "left")
    said, refs = F.coalesce("claim", "summary"), F.coalesce("line_refs", F.array().cast("array<string>"))
    rows = rows.withColumn("content_hash", evidence_hash(F.col("role"), said, refs, F.col("confidence"), F.col("ref"), F.col("sha256")))
    return rows.select("task_id", F.coalesce("place", F.lit(0)).alias("place"), F.concat(F.lit("evidence-"), F.substring("content_hash", 1, 20)).alias("evidence_id"), F.lit("E1").alias("level"), F.lit("llm").alias("source"), said.alias("summary"), refs.alias("line_refs"), "confidence", "content_hash")


def delivery_faults(task: DataFrame, draft: DataFrame, evidence: DataFrame) -> DataFrame:
    """(task_id, fault) of deliveries whose evidence is not derived from what it says, or is not that of the role's output.

    evidence: (task_id, place, evidence_id, summary, line_refs, confidence, content_hash).
    """
    own = evidence.join(task.select("task_id", "role", "ref", "sha256"), "task_id")
    told = lambda rows, fault: rows.select("task_id", F.lit(fault).alias("fault")).distinct()
    hashed = own.withColumn("h", evidence_hash(F.col("role"), F.col("summary"), F.col("line_refs"), F.col("confidence"), F.col("ref"), F.col("sha256")))
    out = told(hashed.where("h <> content_hash"), "HASH_MISMATCH").unionByName(told(hashed.where("evidence_id <> concat('evidence-', left(content_hash, 20))"), "ID_MISMATCH"))
    out = out.unionByName(told(evidence.groupBy("task_id", "evidence_id").count().where("count > 1"), "DUPLICATE_EVIDENCE"))
    said = F.to_json(F.struct("place", "summary", "line_refs", "confidence")).alias("said")
    want, have = worker_evidence(task, draft).select("task_id", said, F.lit(1).alias("w")), evidence.select("task_id", said, F.lit(1).alias("h"))
    both = want.join(have, ["task_id", "said"], "full_outer")
    return out.unionByName(told(both.where("w is null or h is null"), "OUTPUT_MISMATCH"))


def request_faults(request: DataFrame, document: DataFrame, now: F.Column) -> DataFrame:
    """(review_id, fault): requests that are expired, or whose input is missing, not canonical, another one or not safe.

    document: (ref, text, canonical, sha256) as the document source reads it.
    """
    both = request.alias("q").join(document.alias("i"), F.col("q.input_ref") == F.col("i.ref"), "left")
    read = lambda key: F.get_json_object("i.canonical", f"$.{key}")
    fault = (
        F.when(F.col("q.deadline_at") <= now, "EXPIRED").when(F.col("i.ref").isNull(), "INPUT_MISSING").when(~F.col("i.canonical").eqNullSafe(F.col("i.text")), "NOT_CANONICAL").when(F.col("i.sha256") != F.col("q.input_sha256"), "DIGEST_MISMATCH")
        .when(~read("review_id").eqNullSafe(F.col("q.review_id").cast("string")), "REVIEW_MISMATCH").when(~read("cloud_safe").eqNullSafe(F.lit("true")), "NOT_SAFE")
    )
    return both.select("q.review_id", fault.alias("fault")).where("fault is not null")


# What a role's payload holds.
REVIEW_PAYLOAD = "summary string, findings array<struct<category:string,severity:string,title:string,claim:string,recommendation:string,confidence:double,line_refs:array<string>>>"
PAYLOADS = {"diff_analyzer": "summary string, change_intents array<string>, affected_symbols array<string>", "security_scanner": REVIEW_PAYLOAD, "quality_reviewer": REVIEW_PAYLOAD}


def role_payloads(document: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """(accepted with payload, rejected) documents (key, canonical): exactly the role's keys, each of its type, no more drafts than allowed."""
    wanted = F.array(*[F.lit(c.split()[0]) for c in (["summary", "change_intents", "affected_symbols"] if role == "diff_analyzer" else ["summary", "findings"])])
    rows = document.withColumn("payload", F.from_json("canonical", PAYLOADS[role], {"mode": "PERMISSIVE"}))
    whole = F.array_sort(F.json_object_keys("canonical")) == F.array_sort(wanted)
    if role == "diff_analyzer":
        held = F.col("payload.change_intents").isNotNull() & F.col("payload.affected_symbols").isNotNull() & (F.size("payload.change_intents") <= 20) & (F.size("payload.affected_symbols") <= 50)
    else:
        fine = lambda f: f["claim"].isNotNull() & f["confidence"].between(0, 1) & F.size(f["line_refs"]).between(1, 5) & (F.size(f["line_refs"]) == F.size(F.array_distinct(f["line_refs"])))
        held = F.col("payload.findings").isNotNull() & (F.size("payload.findings") <= 10) & F.forall("payload.findings", fine)
    good = F.coalesce(whole & (F.trim("payload.summary") != "") & held, F.lit(False))
    return rows.where(good), rows.where(~good).drop("payload")


def digest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): missing, unexpected or changed files."""
    both = expected.select("path", F.col("sha256").alias("e")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    return both.select("path", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e") != F.col("a"), "changed").alias("state")).where("state is not null")


def tree_digest(files: DataFrame, key: str = "package") -> DataFrame:
    """One digest per package over its sorted (path, sha256) list in canonical form."""
    item = F.concat(F.lit('{"path":"'), "path", F.lit('","sha256":"'), "sha256", F.lit('"}'))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", item.alias("j")))), lambda x: x["j"])
    return files.groupBy(key).agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]\n")), 256).alias("digest"))


def control_messages(assignment: DataFrame) -> DataFrame:
    """(task_id, message, fits): a JSON control message of each assignment, and whether it is within the limit."""
    out = assignment.select("task_id", F.to_json(F.struct("input_sha256", "review_id", "role", "task_id")).alias("message"))
    return out.withColumn("fits", F.octet_length("message") <= MAX_CONTROL_BYTES)


def quiet(samples: DataFrame) -> DataFrame:
    """(key, quiet): three equal samples or more, the first at 0, others at 65 s or later and at 130 s or later."""
    t = F.col("elapsed")
    return samples.groupBy("key").agg(((F.count_distinct("usage") == 1) & (F.count("*") >= 3) & (F.min(t) == 0) & (F.count(F.when(t >= 65, 1)) >= 2) & (F.max(t) >= 130)).alias("quiet"))


def deliveries(finding: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence of a delivery: one row a finding, or a summary row where there is none."""
    own = finding.select("review_id", "finding_id", "severity")
    return reviews.select("review_id").distinct().join(own, "review_id", "left").select("review_id", F.coalesce("finding_id", F.lit("summary")).alias("evidence_ref"), F.coalesce("severity", F.lit("info")).alias("severity"))


def blocked_deliveries(delivery: DataFrame, coverage: DataFrame) -> DataFrame:
    """Deliveries of reviews without a failed deterministic check."""
    failed = coverage.where("status = 'failed' and skill in ('detect_secret', 'detect_injection', 'detect_dangerous_call')").select("review_id").distinct()
    return delivery.join(failed, "review_id", "left_anti")
