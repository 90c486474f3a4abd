"""Assurance: canonical findings and evidence, conflicts between findings, coverage gaps, the report.

finding and evidence are the facts of validation.py: findings carry their places and identity, both carry what is wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITY_RANK, STATUS_RANK, rank, stable_id
from .interval import overlapping
from .validation import SPOT

#: Kinds of conflicts whose findings can't block.
DISQUALIFYING = ["contradiction", "severity_mismatch", "location_mismatch"]


def canonical_findings(finding: DataFrame) -> DataFrame:
    """One row per category and set of places: members, and the representative by validity, status, severity, confidence, id."""
    order = F.struct(~F.col("invalid"), rank(F.col("status"), STATUS_RANK), rank(F.col("severity"), SEVERITY_RANK), "confidence_pct", "finding_id")
    out = finding.groupBy("review_id", "identity").agg(F.max_by("finding_id", order).alias("selected"), F.array_sort(F.collect_set("finding_id")).alias("members"))
    return out.withColumn("canonical_id", F.concat(F.lit("canonical-finding-"), F.substring("identity", 1, 20)))


def represented(groups: DataFrame) -> DataFrame:
    """(review_id, selected, members) of groups of one member, which needs no comparison."""
    return groups.where("size(members) = 1").select("review_id", F.col("members")[0].alias("selected"), "members")


def alike_evidence(evidence: DataFrame) -> GroupedData:
    return evidence.groupBy("review_id", "content_hash", *SPOT)


def canonical_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (content hash, location): the first by id of the highest validity and level."""
    order = F.struct("bad", -F.col("level_rank"), "evidence_id")
    return alike_evidence(evidence.where("here")).agg(F.min_by("evidence_id", order).alias("selected"), F.array_sort(F.collect_set("evidence_id")).alias("members"))


def detected_conflicts(finding: DataFrame, gaps: DataFrame) -> DataFrame:
    """(review_id, conflict_id, type, finding_ids, rule_ids): contradictions, mismatches, coverage gaps with findings."""
    rows = finding.withColumn("sev", rank(F.col("severity"), SEVERITY_RANK))
    ids = F.array_sort(F.collect_set("finding_id")).alias("finding_ids")
    groups = rows.groupBy("review_id", "identity").agg(
        ids, F.count("*").alias("n"), F.bool_or(F.col("status") == "dismissed").alias("no"), F.bool_or(F.col("status").isin("confirmed", "suspected")).alias("yes"), (F.max("sev") - F.min("sev")).alias("spread"),
    ).where("n > 1")
    kinds = F.array_compact(F.array(F.when(F.col("no") & F.col("yes"), F.lit("contradiction")), F.when(F.col("spread") >= 2, F.lit("severity_mismatch"))))
    alike = groups.select("review_id", "identity", "finding_ids", F.explode(kinds).alias("type"))
    prints = rows.groupBy("review_id", F.col("fingerprint").alias("identity")).agg(ids, F.count("*").alias("n"), F.count_distinct("identity").alias("kinds")).where("n > 1 and kinds > 1")
    both = alike.unionByName(prints.select("review_id", "identity", "finding_ids", F.lit("location_mismatch").alias("type")))
    told = both.withColumn("conflict_id", stable_id("conflict", F.col("type"), F.col("identity"), F.array_join("finding_ids", ","))).withColumn("rule_ids", F.array().cast("array<string>"))
    found = gaps.where("size(finding_ids) > 0").withColumn("type", F.lit("coverage_gap"))
    found = found.withColumn("conflict_id", stable_id("conflict", F.col("type"), F.col("route_id"), F.col("skill"), F.array_join("finding_ids", ","))).withColumn("rule_ids", F.array(F.lit("N001")))
    columns = ["review_id", "conflict_id", "type", "finding_ids", "rule_ids"]
    return told.select(columns).unionByName(found.select(columns))


def supplied_conflicts(conflict: DataFrame) -> DataFrame:
    """Supplied conflicts, one row an id, from one row a reference."""
    return conflict.groupBy("review_id", "conflict_id").agg(F.min("type").alias("type"), F.array_sort(F.collect_set("finding_id")).alias("finding_ids"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.bool_and("resolved").alias("resolved"))


def merged_conflicts(detected: DataFrame, supplied: DataFrame) -> DataFrame:
    """Both, one row per id; a supplied conflict wins."""
    both = supplied.withColumn("p", F.lit(0)).unionByName(detected.withColumn("p", F.lit(1)))
    first = F.row_number().over(W.partitionBy("review_id", "conflict_id").orderBy("p"))
    return both.withColumn("r", first).where("r = 1").drop("r", "p")


def all_conflicts(finding: DataFrame, gaps: DataFrame, conflict: DataFrame) -> DataFrame:
    """(review_id, conflict_id, type, finding_ids, rule_ids, resolved)."""
    return merged_conflicts(detected_conflicts(finding, gaps).withColumn("resolved", F.lit(False)), supplied_conflicts(conflict))


def disqualified(conflict: DataFrame) -> DataFrame:
    """Findings of unresolved contradictions, severity and location mismatches (coverage gaps do not disqualify)."""
    return conflict.where("not resolved").where(F.col("type").isin(DISQUALIFYING)).select("review_id", F.explode("finding_ids").alias("finding_id")).distinct()


def related_routes(finding: DataFrame, place: DataFrame, route: DataFrame, route_place: DataFrame) -> DataFrame:
    """Pairs of findings and routes of one category, some place of the finding overlapping one of the route's."""
    own = route.select("review_id", "route_id", "category").distinct()
    asked = finding.select("review_id", "finding_id", "category").join(own, ["review_id", "category"], "left_semi").distinct()
    spots = place.select("review_id", "finding_id", *SPOT[:-1]).join(asked, ["review_id", "finding_id"])
    r = own.join(route_place, ["review_id", "route_id"])
    r = r.select("review_id", "route_id", "category", "file_path", "hunk_id", "side", F.col("start_line").alias("other_start"), F.col("end_line").alias("other_end")).distinct()
    return overlapping(spots, r, ["review_id", "category", "file_path", "hunk_id", "side"]).select("review_id", "finding_id", "route_id").distinct()


def coverage_gaps(route: DataFrame, covered: DataFrame, related: DataFrame) -> DataFrame:
    """(route, skill) pairs without completed coverage, with the findings they concern. covered: coverage, once a route."""
    own = covered.groupBy("review_id", "route_id", "skill").agg(F.bool_and(F.col("status") == "completed").alias("complete"))
    gaps = route.select("review_id", "route_id", "skill").distinct().join(own, ["review_id", "route_id", "skill"], "left").where("not coalesce(complete, false)").drop("complete")
    ids = related.groupBy("review_id", "route_id").agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))
    return gaps.join(ids, ["review_id", "route_id"], "left").withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast("array<string>")))


def report(finding: DataFrame, evidence: DataFrame, issues: DataFrame, found: DataFrame) -> DataFrame:
    """One row per review: counts of records, valid ones, canonical ones, issues and conflicts."""
    count = lambda rows, name: rows.groupBy("review_id").agg(F.count("*").alias(name))
    known = finding.groupBy("review_id").agg(F.count_distinct("finding_id").alias("findings"), F.count_distinct(F.when(~F.col("invalid"), F.col("finding_id"))).alias("valid_findings"), F.count_distinct("identity").alias("canonical_findings"))
    proofs = evidence.where("here").groupBy("review_id").agg(F.count_distinct("evidence_id").alias("evidence"), F.count_distinct(F.when(~F.col("bad"), F.col("evidence_id"))).alias("valid_evidence"))
    out = known
    for p in (proofs, count(canonical_evidence(evidence), "canonical_evidence"), count(issues, "issues"), count(found, "conflicts")):
        out = out.join(p, "review_id", "left")
    return out.fillna(0)
