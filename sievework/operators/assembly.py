"""Joining a review's parts: fallbacks, unions of results, flattened references, the second pass."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .interval import first_lines
from .routing import UNIVERSE
from .transport import canonical_json

# The deterministic skills in the order in which they run, and the roles of a routed review.
DETERMINISTIC = ["detect_secret", "detect_injection", "detect_dangerous_call"]
ROLES = ["diff", "manager", "quality", "security"]
CONTROL_KEYS = ["input_sha256", "review_id", "role", "task_id"]
FORBIDDEN_KEYS = ["content", "diff", "prompt", "source", "token"]


def flattened(**relations: DataFrame) -> DataFrame:
    """(review_id, artifact_id, kind, id): what artifacts hold, from the relations of findings, evidence and coverage."""
    parts = [rows.select("review_id", "artifact_id", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id")) for kind, rows in relations.items()]
    return reduce(DataFrame.unionByName, parts)


def verified_e3(evidence: DataFrame) -> DataFrame:
    """The registry of trusted E3 ids: evidence of that level that a rule or a static tool issued."""
    return evidence.where("level = 'E3' and source in ('rule', 'static_tool')").select("review_id", "evidence_id").distinct()


def out_of_scope(files: DataFrame) -> DataFrame:
    """Reviews that the diff-scope rule holds for: a file is binary, unsupported or beyond the line limit."""
    return files.where("exclusion_reason is not null").select("review_id").distinct()


def deterministic_plan(plan: DataFrame) -> DataFrame:
    return plan.where("planned").where(F.col("skill").isin(DETERMINISTIC)).select("review_id", "skill")


def suite(results: DataFrame) -> DataFrame:
    """(review_id, skill, status, place) for all three skills in frozen order; a skill without a result was skipped."""
    grid = results.select("review_id").distinct().select("review_id", F.posexplode(F.array(*map(F.lit, DETERMINISTIC))).alias("place", "skill"))
    return grid.join(results.select("review_id", "skill", "status"), ["review_id", "skill"], "left").fillna("skipped", ["status"])


def roll_up(status: Column) -> Column:
    """failed before partial and skipped before success."""
    return F.when(F.bool_or(status == "failed"), "failed").when(F.bool_or(status.isin("partial", "skipped")), "partial").otherwise("success")


def artifact_or_failure(reviews: DataFrame, run: DataFrame, agents: list[str]) -> DataFrame:
    """(review_id, agent_id, status, calls): recorded runs, or a synthetic failed one where there is none."""
    grid = reviews.select("review_id").distinct().select("review_id", F.explode(F.array(*map(F.lit, agents))).alias("agent_id"))
    own = run.groupBy("review_id", "agent_id").agg(F.min("status").alias("status"), F.count("*").alias("calls"))
    return grid.join(own, ["review_id", "agent_id"], "left").fillna("failed", ["status"]).fillna(0, ["calls"])


def first_by_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row an id: the first by the order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("review_id", key).orderBy(*order))).where("__n = 1").drop("__n")


def ordered_distinct(value: Column, position: Column) -> Column:
    """Aggregate: distinct values in the order in which they first stand."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v")))), lambda x: x["v"]))


def skipped_skills(plan: DataFrame) -> DataFrame:
    """The universe without the planned skills."""
    grid = plan.select("review_id").distinct().select("review_id", F.explode(F.array(*map(F.lit, UNIVERSE))).alias("skill"))
    return grid.join(plan.where("planned").select("review_id", "skill"), ["review_id", "skill"], "left_anti")


def overlapping_buckets(bucket: DataFrame) -> DataFrame:
    """Findings in more than one bucket of a decision: there must be none."""
    return bucket.groupBy("review_id", "finding_id").agg(F.count_distinct("bucket").alias("n")).where("n > 1")


def node_lines(node: DataFrame, line: DataFrame) -> DataFrame:
    """(review_id, hunk_id, node, line_number): the first line, and rather the first added one, within each node's span."""
    return first_lines(node, line, ["review_id", "hunk_id"])


def appended(before: DataFrame, after: DataFrame, linked: DataFrame) -> DataFrame:
    """Reviews whose new evidence ids are not exactly those linked by the recheck."""
    new = after.select("review_id", "evidence_id").join(before.select("review_id", "evidence_id"), ["review_id", "evidence_id"], "left_anti").withColumn("a", F.lit(1))
    both = new.join(linked.select("review_id", "evidence_id").distinct().withColumn("b", F.lit(1)), ["review_id", "evidence_id"], "full_outer")
    return both.where("a is null or b is null").select("review_id").distinct()


def complete_routes(assignment: DataFrame) -> DataFrame:
    """Reviews that have exactly one assignment of every role."""
    out = assignment.groupBy("review_id").agg(F.array_sort(F.collect_list("role")).alias("roles"))
    return out.where(F.col("roles") == F.array(*map(F.lit, ROLES))).select("review_id")


@F.pandas_udf(T.BooleanType())
def is_control_message(text: pd.Series) -> pd.Series:
    """True for a JSON object with exactly the control keys and no forbidden key at any depth."""

    def keys(value: object) -> set:
        if isinstance(value, dict):
            return set(value) | {k for v in value.values() for k in keys(v)}
        return {k for v in value for k in keys(v)} if isinstance(value, list) else set()

    def one(t: str | None) -> bool:
        try:
            value = json.loads(t)
        except (TypeError, ValueError, RecursionError):
            return False
        return isinstance(value, dict) and sorted(value) == CONTROL_KEYS and not keys(value) & set(FORBIDDEN_KEYS)

    return text.map(one)


@F.pandas_udf(T.StringType())
def without_times(text: pd.Series) -> pd.Series:
    """Canonical JSON without keys that end in At, _at or Timestamp, lists of texts sorted; null for what is not JSON."""

    def plain(value: object) -> object:
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items() if not k.endswith(("At", "_at", "Timestamp", "timestamp"))}
        if isinstance(value, list):
            return sorted(value) if value and all(isinstance(v, str) for v in value) else [plain(v) for v in value]
        return value

    def one(t: str | None) -> str | None:
        try:
            return canonical_json(plain(json.loads(t)))
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(one)
