"""Integrity of a review's records, as facts: one row a record, with the codes of what is wrong with it.

Relations, all keyed by review_id (see plans/fixtures.py for their columns): finding, place (the locations of a finding, any
number), evidence, link (finding to evidence), verified (trusted E3 ids), hunk (the parsed diff), route (one row a route and
skill), route_place, coverage (one row a record), coverage_route and coverage_file (any number a record), artifact, lineage, root, conflict (one row a reference). Every fact is made once; issues, invalid records
and the gate's rules are read off the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import LEVEL_RANK, content_hash, overlaps, rank
from ..scratch import cut, small
from . import cycles
from .policy import FROZEN, Policy
from .routing import ALWAYS_ON

# Issue codes that count as tampering.
TAMPER_CODES = ["ARTIFACT_LINEAGE_CYCLE", "ARTIFACT_LINEAGE_DANGLING", "CONFLICT_FINDING_DANGLING", "CONFLICT_RULE_DANGLING", "DUPLICATE_ARTIFACT_ID", "DUPLICATE_CONFLICT_ID", "DUPLICATE_COVERAGE_ID", "DUPLICATE_EVIDENCE_ID", "DUPLICATE_FINDING_ID", "E3_PROVENANCE_UNVERIFIED", "EVIDENCE_FINDING_LOCATION_MISMATCH", "EVIDENCE_LOCATION_INVALID", "FINDING_EVIDENCE_DANGLING", "FINDING_LOCATION_INVALID", "ROUTE_LOCATION_INVALID", "VERIFIED_E3_DANGLING"]
#: Codes by the relation whose facts tell them.
EVIDENCE_CODES = ("DUPLICATE_EVIDENCE_ID", "EVIDENCE_LOCATION_INVALID", "E3_PROVENANCE_UNVERIFIED", "E3_DETECTOR_NOT_ALLOWED", "VERIFIED_E3_DANGLING", "VERIFIED_E3_NOT_E3")
FINDING_CODES = ("DUPLICATE_FINDING_ID", "FINDING_LOCATION_INVALID", "FINDING_EVIDENCE_DANGLING", "FINDING_HAS_NO_QUALIFIED_EVIDENCE", "EVIDENCE_FINDING_LOCATION_MISMATCH")
COVERAGE_CODES = ("DUPLICATE_COVERAGE_ID", "COVERAGE_ROUTE_DANGLING", "COVERAGE_FILE_INVALID", "MANDATORY_COVERAGE_DOWNGRADED")
CONFLICT_CODES = ("DUPLICATE_CONFLICT_ID", "CONFLICT_FINDING_DANGLING", "CONFLICT_RULE_DANGLING")
SPOT = ["file_path", "hunk_id", "side", "start_line", "end_line", "snippet_hash"]


def _codes(**rules: Column) -> Column:
    """Array of the issue codes whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(code)) for code, hit in rules.items()]))


def _issues(rows: DataFrame, code: str, subject: str | Column) -> DataFrame:
    what = F.col(subject) if isinstance(subject, str) else subject
    return rows.select("review_id", F.lit(code).alias("code"), what.alias("subject")).distinct()


def told(facts: DataFrame, subject: str) -> DataFrame:
    """(review_id, code, subject) of facts with codes."""
    return facts.select("review_id", F.explode("codes").alias("code"), F.col(subject).alias("subject"))


def _copies(key: str) -> Column:
    return F.count("*").over(W.partitionBy("review_id", key))


def with_hunks(rows: DataFrame, hunk: DataFrame) -> DataFrame:
    """Adds misplaced: the hunk of a located row is unknown, or its path is not that side's path of the hunk."""
    known = hunk.select("review_id", "hunk_id", "old_path", "new_path")
    own = F.when(F.col("side") == "old", F.col("old_path")).otherwise(F.col("new_path"))
    misplaced = F.col("hunk_id").isNotNull() & ~F.coalesce(own == F.col("file_path"), F.lit(False))
    return rows.join(known, ["review_id", "hunk_id"], "left").withColumn("misplaced", misplaced).drop("old_path", "new_path")


def with_origin(rows: DataFrame, artifact: DataFrame) -> DataFrame:
    """Adds foreign: the row's artifact names another review. Such artifacts are written; few are broadcast, so that the rows stay where they are."""
    other = cut(review_mismatches(artifact).select("review_id", F.col("subject").alias("artifact_id"), F.lit(True).alias("foreign")), "foreign")
    return rows.join(small(other), ["review_id", "artifact_id"], "left").withColumn("foreign", F.coalesce("foreign", F.lit(False)))


def evidence_facts(evidence: DataFrame, verified: DataFrame, hunk: DataFrame, artifact: DataFrame, policy: Policy = FROZEN) -> DataFrame:
    """Evidence with level_rank, bad and codes; entries of the registry without evidence have here null."""
    rows = with_origin(with_hunks(evidence, hunk), artifact).withColumns({"copies": _copies("evidence_id"), "here": F.lit(True)})
    registry = verified.select("review_id", "evidence_id", F.lit(True).alias("registered")).distinct()
    e3, registered = F.col("level") == "E3", F.coalesce("registered", F.lit(False))
    invalid = {"DUPLICATE_EVIDENCE_ID": F.col("copies") > 1, "EVIDENCE_LOCATION_INVALID": F.col("misplaced"), "E3_PROVENANCE_UNVERIFIED": e3 & ~registered, "E3_DETECTOR_NOT_ALLOWED": _not_allowed(policy)}
    others = {"VERIFIED_E3_DANGLING": F.col("here").isNull(), "VERIFIED_E3_NOT_E3": registered & ~e3}
    bad = F.coalesce(F.col("foreign") | (F.size(_codes(**invalid)) > 0), F.lit(True))
    out = rows.join(registry, ["review_id", "evidence_id"], "full_outer")
    return out.withColumns({"level_rank": rank(F.col("level"), LEVEL_RANK), "bad": bad, "codes": _codes(**invalid, **others)})


def finding_places(place: DataFrame, hunk: DataFrame) -> DataFrame:
    """(review_id, finding_id, places, misplaced, new_side): all locations of a finding; none have no row."""
    return with_hunks(place, hunk).groupBy("review_id", "finding_id").agg(F.array_sort(F.collect_set(F.struct(*SPOT))).alias("places"), F.bool_or("misplaced").alias("misplaced"), F.bool_or(F.col("side") == "new").alias("new_side"))


def supports(places: Column, spot: Column) -> Column:
    """Evidence at a spot supports a finding without places, or one with a place of that file, hunk and side that it overlaps."""
    same = lambda p: (p["file_path"] == spot["file_path"]) & (p["hunk_id"] == spot["hunk_id"]) & (p["side"] == spot["side"]) & overlaps(p["start_line"], p["end_line"], spot["start_line"], spot["end_line"])
    return places.isNull() | F.coalesce(F.exists(places, same), F.lit(False))


def pair_facts(link: DataFrame, places: DataFrame, facts: DataFrame) -> DataFrame:
    """(review_id, finding_id, evidence_id, known, mismatch, good, level_rank, evidence_side) of every link, repeated ones included."""
    known = facts.where("here").select("review_id", "evidence_id", "level_rank", "bad", F.col("side").alias("evidence_side"), F.struct(*SPOT).alias("spot"))
    rows = link.select("review_id", "finding_id", "evidence_id").join(known, ["review_id", "evidence_id"], "left").join(places.select("review_id", "finding_id", "places"), ["review_id", "finding_id"], "left")
    here, fits = F.col("level_rank").isNotNull(), supports(F.col("places"), F.col("spot"))
    return rows.select("review_id", "finding_id", "evidence_id", here.alias("known"), (here & ~fits).alias("mismatch"), (here & fits & ~F.col("bad")).alias("good"), "level_rank", "evidence_side")


def _identity() -> Column:
    """What findings of one category and one set of places share."""
    where = F.array_join(F.transform("places", lambda p: F.concat_ws("\x01", *[p[c].cast("string") for c in SPOT])), "\x02")
    return content_hash(F.col("category"), F.coalesce(where, F.lit("")))


def identified(finding: DataFrame, place: DataFrame) -> DataFrame:
    """Findings with identity, off their places alone."""
    places = place.groupBy("review_id", "finding_id").agg(F.array_sort(F.collect_set(F.struct(*SPOT))).alias("places"))
    return finding.join(places, ["review_id", "finding_id"], "left").withColumn("identity", _identity()).drop("places")


def finding_facts(finding: DataFrame, places: DataFrame, pair: DataFrame, artifact: DataFrame) -> DataFrame:
    """Findings with places, identity, the qualified evidence, best new-side level, invalid and issues (code, subject)."""
    good = F.col("good")
    per = pair.groupBy("review_id", "finding_id").agg(
        F.bool_or(~F.col("known")).alias("dangling"), F.bool_or(good & (F.col("level_rank") > 0)).alias("usable"), F.max(F.when(good & (F.col("evidence_side") == "new"), F.col("level_rank"))).alias("best_new"),
        F.array_sort(F.collect_set(F.when(F.col("mismatch"), F.col("evidence_id")))).alias("mismatched"), F.array_sort(F.collect_set(F.when(good, F.col("evidence_id")))).alias("evidence_ids"),
    )
    rows = with_origin(finding, artifact).withColumn("copies", _copies("finding_id")).join(places, ["review_id", "finding_id"], "left").join(per, ["review_id", "finding_id"], "left")
    active = F.col("status").isin("confirmed", "suspected")
    codes = _codes(DUPLICATE_FINDING_ID=F.col("copies") > 1, FINDING_LOCATION_INVALID=F.col("misplaced"), FINDING_EVIDENCE_DANGLING=F.col("dangling"), FINDING_HAS_NO_QUALIFIED_EVIDENCE=active & ~F.coalesce("usable", F.lit(False)))
    none = F.array().cast("array<string>")
    own = F.transform(codes, lambda c: F.struct(c.alias("code"), F.col("finding_id").alias("subject")))
    apart = F.transform(F.coalesce("mismatched", none), lambda e: F.struct(F.lit("EVIDENCE_FINDING_LOCATION_MISMATCH").alias("code"), F.concat_ws(":", "finding_id", e).alias("subject")))
    return rows.withColumns({
        "identity": _identity(), "invalid": F.col("foreign") | (F.size(codes) > 0), "issues": F.concat(own, apart),
        "evidence_ids": F.coalesce("evidence_ids", none), "new_side": F.coalesce("new_side", F.lit(False)),
    }).drop("mismatched")


def coverage_facts(coverage: DataFrame, coverage_route: DataFrame, coverage_file: DataFrame, route: DataFrame, hunk: DataFrame, artifact: DataFrame, policy: Policy = FROZEN, always_on: list[str] = ALWAYS_ON) -> DataFrame:
    """Coverage records with bad and codes; a record names any number of routes and files, in relations of their own."""
    known = route.groupBy("review_id", "route_id").agg(F.collect_set(F.when(F.col("mandatory"), F.col("skill"))).alias("asked"))
    named = coverage_route.select("review_id", "coverage_id", "route_id").join(known, ["review_id", "route_id"], "left")
    routes = named.groupBy("review_id", "coverage_id").agg(F.bool_or(F.col("asked").isNull()).alias("lost"), F.array_distinct(F.flatten(F.collect_set("asked"))).alias("asked"))
    inside = known_paths(hunk).select("review_id", F.col("path").alias("file_path"))
    outside = coverage_file.join(inside, ["review_id", "file_path"], "left_anti").select("review_id", "coverage_id", F.lit(True).alias("outside")).distinct()
    rows = with_origin(coverage, artifact).withColumn("copies", _copies("coverage_id")).join(routes, ["review_id", "coverage_id"], "left").join(outside, ["review_id", "coverage_id"], "left")
    wanted = F.coalesce(F.array_contains("asked", F.col("skill")), F.lit(False)) | F.col("skill").isin([s for s in policy.always_required if s in always_on])
    codes = _codes(DUPLICATE_COVERAGE_ID=F.col("copies") > 1, COVERAGE_ROUTE_DANGLING=F.col("lost"), COVERAGE_FILE_INVALID=F.col("outside"), MANDATORY_COVERAGE_DOWNGRADED=wanted & ~F.col("mandatory"))
    return rows.withColumns({"bad": F.col("foreign") | (F.size(codes) > 0), "codes": codes}).drop("lost", "asked", "outside")


def covered_routes(coverage: DataFrame, coverage_route: DataFrame) -> DataFrame:
    """Coverage records, once for every route that they name."""
    return coverage.join(coverage_route.select("review_id", "coverage_id", "route_id").distinct(), ["review_id", "coverage_id"])


def known_paths(hunk: DataFrame) -> DataFrame:
    return hunk.select("review_id", F.explode(F.array("old_path", "new_path")).alias("path")).where("path is not null").distinct()


def planned_coverage(review: DataFrame, route: DataFrame, coverage: DataFrame, covered: DataFrame, always_on: list[str] = ALWAYS_ON) -> DataFrame:
    """Issues of planned (route, skill) pairs, and of always-on skills of a review, that no coverage record names."""
    pairs = route.select("review_id", "route_id", "skill").distinct().join(covered, ["review_id", "route_id", "skill"], "left_anti")
    grid = review.select("review_id").distinct().select("review_id", F.explode(F.array(*map(F.lit, always_on))).alias("skill")).join(coverage, ["review_id", "skill"], "left_anti")
    return _issues(pairs, "PLANNED_COVERAGE_MISSING", F.concat_ws(":", "route_id", "skill")).unionByName(_issues(grid, "PLANNED_COVERAGE_MISSING", "skill"))


def dangling_lineage(lineage: DataFrame, artifact: DataFrame, root: DataFrame | None = None) -> DataFrame:
    known = artifact.select("review_id", F.col("artifact_id").alias("parent_id"))
    known = known if root is None else known.unionByName(root.select("review_id", F.col("root_id").alias("parent_id")))
    return _issues(lineage.join(known, ["review_id", "parent_id"], "left_anti"), "ARTIFACT_LINEAGE_DANGLING", "artifact_id")


def lineage_cycles(lineage: DataFrame) -> DataFrame:
    """Artifacts on a cycle of their review's lineage."""
    links = lineage.select("review_id", F.col("artifact_id").alias("a"), F.col("parent_id").alias("b"))
    return _issues(cycles.on_cycle(links, "review_id"), "ARTIFACT_LINEAGE_CYCLE", "node")


def review_mismatches(artifact: DataFrame) -> DataFrame:
    return _issues(artifact.where("own_review_id <> review_id"), "ARTIFACT_REVIEW_MISMATCH", "artifact_id")


def repeated_artifacts(artifact: DataFrame) -> DataFrame:
    return _issues(artifact.groupBy("review_id", "artifact_id").count().where("count > 1"), "DUPLICATE_ARTIFACT_ID", "artifact_id")


def route_issues(route_place: DataFrame, hunk: DataFrame) -> DataFrame:
    return _issues(with_hunks(route_place, hunk).where("misplaced"), "ROUTE_LOCATION_INVALID", "route_id")


def last_entries(conflict: DataFrame) -> DataFrame:
    """Of supplied conflicts that share an id, the rows of the last entry."""
    last = conflict.groupBy("review_id", "conflict_id").agg(F.max("entry").alias("entry"))
    return conflict.join(last, ["review_id", "conflict_id", "entry"], "left_semi")


def conflict_issues(conflict: DataFrame, finding: DataFrame, policy: Policy = FROZEN) -> DataFrame:
    """Of supplied conflicts (review_id, conflict_id, entry, finding_id, rule_id): repeated ids, unknown findings and rules."""
    many = conflict.groupBy("review_id", "conflict_id").agg(F.count_distinct("entry").alias("n")).where("n > 1")
    unknown = conflict.where("finding_id is not null").join(finding.select("review_id", "finding_id"), ["review_id", "finding_id"], "left_anti")
    other = conflict.where(~F.col("rule_id").isin(policy.rule_ids()))
    return _issues(many, "DUPLICATE_CONFLICT_ID", "conflict_id").unionByName(_issues(unknown, "CONFLICT_FINDING_DANGLING", "conflict_id")).unionByName(_issues(other, "CONFLICT_RULE_DANGLING", "conflict_id"))


# ---- issues of some codes, off the ids and places that tell them: what facts tell too, without making them -----------------


def _known(evidence: DataFrame) -> DataFrame:
    """Evidence that a link may name: that of a level."""
    return evidence.where(rank(F.col("level"), LEVEL_RANK).isNotNull())


def _of_findings(rows: DataFrame, finding: DataFrame) -> DataFrame:
    return rows.join(finding.select("review_id", "finding_id"), ["review_id", "finding_id"], "left_semi")


def _not_allowed(policy: Policy) -> Column:
    return (F.col("level") == "E3") & ~F.coalesce(F.struct("source", "detector_name", "detector_version").isin([F.struct(*map(F.lit, q)) for q in policy.qualifiers]), F.lit(False))


def dangling_links(finding: DataFrame, link: DataFrame, evidence: DataFrame) -> DataFrame:
    lost = link.select("review_id", "finding_id", "evidence_id").join(_known(evidence).select("review_id", "evidence_id"), ["review_id", "evidence_id"], "left_anti")
    return _issues(_of_findings(lost, finding), "FINDING_EVIDENCE_DANGLING", "finding_id")


def mismatched_links(finding: DataFrame, place: DataFrame, link: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links of findings with places to evidence that overlaps none of them."""
    spot = F.struct(*[c for c in SPOT if c != "snippet_hash"])
    known = _known(evidence).select("review_id", "evidence_id", spot.alias("spot"))
    places = place.groupBy("review_id", "finding_id").agg(F.collect_set(spot).alias("places"))
    pairs = link.select("review_id", "finding_id", "evidence_id").join(known, ["review_id", "evidence_id"]).join(places, ["review_id", "finding_id"])
    apart = pairs.where(~supports(F.col("places"), F.col("spot"))).select("review_id", "finding_id", "evidence_id")
    return _issues(_of_findings(apart, finding), "EVIDENCE_FINDING_LOCATION_MISMATCH", F.concat_ws(":", "finding_id", "evidence_id"))


def misplaced_findings(finding: DataFrame, place: DataFrame, hunk: DataFrame) -> DataFrame:
    return _issues(_of_findings(with_hunks(place, hunk).where("misplaced"), finding), "FINDING_LOCATION_INVALID", "finding_id")


def misplaced_evidence(evidence: DataFrame, hunk: DataFrame) -> DataFrame:
    return _issues(with_hunks(evidence, hunk).where("misplaced"), "EVIDENCE_LOCATION_INVALID", "evidence_id")


def unverified_evidence(evidence: DataFrame, verified: DataFrame) -> DataFrame:
    e3 = evidence.where("level = 'E3'").select("review_id", "evidence_id")
    return _issues(e3.join(verified.select("review_id", "evidence_id"), ["review_id", "evidence_id"], "left_anti"), "E3_PROVENANCE_UNVERIFIED", "evidence_id")


def registered_evidence(evidence: DataFrame, verified: DataFrame, policy: Policy = FROZEN) -> DataFrame:
    """E3 evidence of an allowed detector that the registry has."""
    e3 = evidence.where((F.col("level") == "E3") & ~_not_allowed(policy))
    return e3.join(verified.select("review_id", "evidence_id"), ["review_id", "evidence_id"], "left_semi")


def disallowed_evidence(evidence: DataFrame, policy: Policy = FROZEN) -> DataFrame:
    return _issues(evidence.where(_not_allowed(policy)), "E3_DETECTOR_NOT_ALLOWED", "evidence_id")


def registry_issues(verified: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entries of the registry without evidence, and those whose evidence is of another level."""
    own = evidence.select("review_id", "evidence_id", "level", F.lit(True).alias("here"))
    codes = _codes(VERIFIED_E3_DANGLING=F.col("here").isNull(), VERIFIED_E3_NOT_E3=F.col("level") != "E3")
    return told(verified.select("review_id", "evidence_id").join(own, ["review_id", "evidence_id"], "left").withColumn("codes", codes), "evidence_id")


def lost_routes(coverage: DataFrame, coverage_route: DataFrame, route: DataFrame) -> DataFrame:
    lost = coverage_route.join(route.select("review_id", "route_id"), ["review_id", "route_id"], "left_anti")
    return _issues(lost.join(coverage.select("review_id", "coverage_id"), ["review_id", "coverage_id"], "left_semi"), "COVERAGE_ROUTE_DANGLING", "coverage_id")


def outside_files(coverage: DataFrame, coverage_file: DataFrame, hunk: DataFrame) -> DataFrame:
    outside = coverage_file.join(known_paths(hunk).withColumnRenamed("path", "file_path"), ["review_id", "file_path"], "left_anti")
    return _issues(outside.join(coverage.select("review_id", "coverage_id"), ["review_id", "coverage_id"], "left_semi"), "COVERAGE_FILE_INVALID", "coverage_id")


def finding_issues(finding: DataFrame) -> DataFrame:
    """The issues that the facts of findings tell."""
    return finding.select("review_id", F.explode("issues").alias("i")).select("review_id", "i.code", "i.subject")


def broken_core(review: DataFrame) -> DataFrame:
    """Reviews without a trustworthy core: no trace or time of decision, or parts that name another review."""
    whole = (F.trim("trace_id") != "") & F.col("decided_at").isNotNull() & (F.col("diff_review_id") == F.col("review_id")) & (F.col("risk_review_id") == F.col("review_id"))
    return review.where(~F.coalesce(whole, F.lit(False))).select("review_id").distinct()
