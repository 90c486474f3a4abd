"""One bounded recheck of reviews that need a person: targets, scope checks of the results, applying them.

Targets are rows (review_id, target_id, kind, subject, finding_ids, conflict_id, skill, route_id, places). Results come as
relations: result (one row a review), added (new evidence), added_link, added_verified, finding_resolution,
conflict_resolution and coverage_update.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from ..scratch import cut
from . import policy
from .assembly import DETERMINISTIC
from .gate import Gate
from .interval import overlapping
from .validation import SPOT

# Targets of a request, and the skills that a quality artifact covers.
MAX_TARGETS = 20
QUALITY_SKILLS = ["review_code_quality"]
_PLACES = f"array<struct<{', '.join(f'{c}:{t}' for c, t in zip(SPOT, ['string', 'string', 'string', 'bigint', 'bigint', 'string'], strict=True))}>>"


def targets(gate: Gate, located: bool = True) -> DataFrame:
    """The targets of all reviews whose status is NEEDS_REVIEW; not located: those of conflicts and routes without their places, for which nothing is read."""
    spotted = lambda rows, spots, *keys: rows.join(spots, [*keys], "left") if located else rows.withColumn("places", F.lit(None).cast(_PLACES))
    none, text = F.array().cast("array<string>"), lambda: F.lit(None).cast("string")
    wanted = gate.decisions.where("status = 'NEEDS_REVIEW'").select("review_id")
    finding = gate.finding.select("review_id", "finding_id", F.col("places").cast(_PLACES).alias("places")).dropDuplicates(["review_id", "finding_id"])
    open_ = gate.conflicts.where("not resolved").select("review_id", "conflict_id", "finding_ids")
    cited = open_.select("review_id", "conflict_id", F.explode("finding_ids").alias("finding_id"))
    spots = cited.join(finding, ["review_id", "finding_id"], "left").groupBy("review_id", "conflict_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    by_conflict = spotted(open_, spots, "review_id", "conflict_id").select("review_id", F.lit("conflict").alias("kind"), F.col("conflict_id").alias("subject"), "finding_ids", "conflict_id", text().alias("skill"), text().alias("route_id"), "places")
    asked = gate.buckets.where("bucket = 'review'").select("review_id", "finding_id").unionByName(gate.finding.where("invalid").select("review_id", "finding_id")).distinct().join(cited, ["review_id", "finding_id"], "left_anti")
    by_finding = asked.join(finding.where("places is not null"), ["review_id", "finding_id"]).select("review_id", F.lit("finding").alias("kind"), F.col("finding_id").alias("subject"), F.array("finding_id").alias("finding_ids"), text().alias("conflict_id"), text().alias("skill"), text().alias("route_id"), "places")
    valid = gate.coverage.where("not bad").withColumn("done", F.col("mandatory") & (F.col("status") == "completed"))
    review, route = gate.r["review"], gate.r["route"]
    always = review.select("review_id").distinct().select("review_id", F.explode(F.array(*map(F.lit, gate.always_on))).alias("skill")).join(valid.groupBy("review_id", "skill").agg(F.bool_and("done").alias("done")), ["review_id", "skill"], "left").withColumns({"route_id": text(), "places": F.array().cast(_PLACES)})
    by_route = gate.covered.where("not bad").groupBy("review_id", "route_id", "skill").agg(F.bool_and(F.col("mandatory") & (F.col("status") == "completed")).alias("done"))
    spots = gate.r["route_place"].groupBy("review_id", "route_id").agg(F.array_sort(F.collect_set(F.struct(*SPOT))).cast(_PLACES).alias("places"))
    routed = route.where("mandatory").select("review_id", "route_id", "skill").distinct().join(by_route, ["review_id", "route_id", "skill"], "left")
    routed = spotted(routed, spots, "review_id", "route_id").select("review_id", "skill", "done", "route_id", "places")
    lacking = always.unionByName(routed).where("not coalesce(done, false)")
    by_coverage = lacking.select("review_id", F.lit("coverage").alias("kind"), F.concat_ws(":", "skill", "route_id").alias("subject"), none.alias("finding_ids"), text().alias("conflict_id"), "skill", "route_id", "places")
    out = by_conflict.unionByName(by_finding).unionByName(by_coverage).join(wanted, "review_id", "left_semi")
    return out.withColumn("target_id", stable_id("target", F.col("kind"), F.col("subject")))


def requests(target: DataFrame) -> DataFrame:
    """(review_id, request_id, targets): one request a review; its targets in the order of their ids."""
    ids = F.array_sort(F.collect_set("target_id"))
    return target.groupBy("review_id").agg(F.size(ids).alias("targets"), ids.alias("ids")).select("review_id", stable_id("recheck", F.col("review_id"), F.array_join("ids", "\0")).alias("request_id"), "targets")


def oversized(target: DataFrame, limit: int = MAX_TARGETS) -> DataFrame:
    """Reviews with more targets than a request may hold: execution fails, nothing is cut."""
    return target.groupBy("review_id").agg(F.count_distinct("target_id").alias("targets")).where(F.col("targets") > limit)


def violations(request: DataFrame, target: DataFrame, original: DataFrame, finding: DataFrame, result: DataFrame, added: DataFrame, added_link: DataFrame, added_verified: DataFrame, finding_resolution: DataFrame, conflict_resolution: DataFrame, coverage_update: DataFrame) -> DataFrame:
    """(review_id, rule) of results that are not those of their request or leave its scope; such results are not applied."""
    named, alone = F.col("key").isNotNull(), F.col("review_id").isNull()
    lacks = lambda c: (F.col(c) == 0) | alone  # noqa: E731  # rows of no review meet no others

    def grouped(rows: dict[str, DataFrame], *keys: str, **rules: Column) -> DataFrame:
        """The rules that hold of a key, off how many rows each relation has of it: one shuffle for all of them."""
        marks = [part.select("review_id", *keys, *[F.lit(int(n == name)).alias(n) for n in rows]) for name, part in rows.items()]
        counts = functools.reduce(DataFrame.unionByName, marks).groupBy("review_id", *keys).agg(*[F.sum(n).alias(n) for n in rows])
        return _told(counts, **rules)

    by = lambda rows, key: rows.select("review_id", F.col(key).alias("key"))
    proof = added.where("source <> 'llm' and level in ('E2', 'E3') and hunk_id is not null").select("review_id", "evidence_id").join(added_link, ["review_id", "evidence_id"])
    asked = target.select("review_id", F.explode("finding_ids").alias("key"))
    kinds = {"conflict": ("conflict_id", conflict_resolution), "skill": ("skill", coverage_update), "route": ("route_id", coverage_update)}
    kind = lambda rows, name, key: by(rows, key).withColumn("kind", F.lit(name))
    both = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    beyond = (F.col("used") > 0) & named & lacks("asked")
    located = added.where("hunk_id is not null")
    spots = target.select("review_id", F.explode("places").alias("p")).select("review_id", "p.file_path", "p.hunk_id", "p.side", F.col("p.start_line").alias("other_start"), F.col("p.end_line").alias("other_end")).distinct()
    inside = overlapping(located.select("review_id", "evidence_id", "file_path", "hunk_id", "side", "start_line", "end_line"), spots, ["review_id", "file_path", "hunk_id", "side"]).select("review_id", "evidence_id")
    out = [
        _told(
            result.join(request, "review_id", "left"), NOT_SUCCESSFUL=F.col("status") != "success", REQUEST_MISMATCH=~F.col("given_request_id").eqNullSafe(F.col("request_id")),
            REVIEW_MISMATCH=F.col("given_review_id") != F.col("review_id"), ATTEMPT_MISMATCH=F.col("attempt") != 1,
        ),
        grouped(
            {"new": by(added, "evidence_id"), "e3": by(added.where("level = 'E3'"), "evidence_id"), "old": by(original, "evidence_id"), "registered": by(added_verified, "evidence_id"), "linked": by(added_link, "evidence_id")}, "key",
            EVIDENCE_REPEATED=F.col("new") > 1, EVIDENCE_LINKED_TWICE=F.col("linked") > 1, EVIDENCE_NOT_NEW=(F.col("new") > 0) & named & ~lacks("old"),
            REGISTRY_OUT_OF_SCOPE=(F.col("registered") > 0) & named & lacks("new"), E3_UNREGISTERED=named & ((F.col("e3") > 0) & lacks("registered") | (F.col("registered") > 0) & lacks("e3")),
            EVIDENCE_UNLINKED=named & ((F.col("new") > 0) & lacks("linked") | (F.col("linked") > 0) & lacks("new")),
        ),
        grouped(
            {"asked": asked, "known": by(finding, "finding_id"), "linked": by(added_link, "finding_id"), "resolved": by(finding_resolution, "finding_id"), "judged": by(finding_resolution.where("status in ('confirmed', 'dismissed')"), "finding_id"), "proven": by(proof, "finding_id")}, "key",
            LINK_OUT_OF_SCOPE=(F.col("linked") > 0) & named & lacks("asked"), FINDING_OUT_OF_SCOPE=(F.col("resolved") > 0) & named & lacks("asked"), EVIDENCE_UNASSIGNED=(F.col("linked") > 0) & named & lacks("known"),
            UNSUPPORTED_STATUS=(F.col("judged") > 0) & (lacks("proven") | ~named),
        ),
        grouped(
            {"asked": both([kind(target, n, key) for n, (key, _) in kinds.items()]), "used": both([kind(rows, n, key) for n, (key, rows) in kinds.items()])}, "kind", "key",
            CONFLICT_OUT_OF_SCOPE=(F.col("kind") == "conflict") & beyond, COVERAGE_OUT_OF_SCOPE=(F.col("kind") != "conflict") & beyond,
        ),
        _told(coverage_update, COVERAGE_OUT_OF_SCOPE=~F.col("mandatory")),
        located.join(inside, ["review_id", "evidence_id"], "left_anti").select("review_id", F.lit("EVIDENCE_OUT_OF_PLACE").alias("rule")),
    ]
    return both(out).distinct()


def _told(rows: DataFrame, **rules: Column) -> DataFrame:
    """(review_id, rule) of the rules that hold of a row."""
    return rows.select("review_id", F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(rule)) for rule, hit in rules.items()]))).alias("rule"))


def accepted(rows: DataFrame, violation: DataFrame) -> DataFrame:
    """Rows of a result relation whose review breaks no rule."""
    return rows.join(violation.select("review_id").distinct(), "review_id", "left_anti")


def apply_findings(finding: DataFrame, resolution: DataFrame) -> DataFrame:
    """Findings with the statuses of accepted resolutions."""
    new = resolution.select("review_id", "finding_id", F.col("status").alias("new_status"))
    return finding.join(new, ["review_id", "finding_id"], "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def apply_evidence(evidence: DataFrame, added: DataFrame, added_link: DataFrame, finding: DataFrame) -> DataFrame:
    """Evidence and the accepted new one, which goes to the artifact of the finding that it is linked to."""
    owner = added_link.join(finding.select("review_id", "finding_id", "artifact_id"), ["review_id", "finding_id"]).select("review_id", "evidence_id", "artifact_id").distinct()
    return evidence.unionByName(added.drop("artifact_id").join(owner, ["review_id", "evidence_id"]), allowMissingColumns=True)


def apply_conflicts(conflict: DataFrame, resolution: DataFrame) -> DataFrame:
    done = resolution.select("review_id", "conflict_id", F.lit(True).alias("done")).distinct()
    return conflict.join(done, ["review_id", "conflict_id"], "left").withColumn("resolved", F.col("resolved") | F.coalesce("done", F.lit(False))).drop("done")


def replace_coverage(coverage: DataFrame, new: DataFrame) -> DataFrame:
    """Coverage with rows of (review_id, skill, status) in place of the same skill's."""
    own = new.select("review_id", "skill", F.col("status").alias("new_status"))
    out = coverage.join(own, ["review_id", "skill"], "left")
    return out.withColumns({"status": F.coalesce("new_status", "status"), "error_code": F.when(F.col("new_status").isNull() | (F.col("new_status") == "failed"), F.col("error_code"))}).drop("new_status")


def exhausted(rules: DataFrame, review: DataFrame) -> DataFrame:
    """Rules of the gate with N008 for reviews whose one recheck is used up."""
    used = review.select("review_id", F.lit(True).alias("used")).distinct()
    out = rules.join(used, "review_id", "left")
    return out.withColumn("rules", F.when(F.coalesce("used", F.lit(False)), F.array_union("rules", F.array(F.lit("N008")))).otherwise(F.col("rules"))).drop("used")


def rerun(target: DataFrame, observed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result, coverage_update) of a deterministic executor that ran the targeted skills again.

    observed: (review_id, skill, status, error_code) of the fresh run; found: (review_id, skill) with a finding in it. Only
    deterministic skills are rerun: reviews that target none succeed without updates. A review fails if a targeted skill
    failed again or was not observed, or if the run found something.
    """
    asked = target.where(F.col("skill").isin(DETERMINISTIC)).select("review_id", "skill", "route_id").distinct()
    hot = found.select("review_id", "skill", F.lit(True).alias("found")).distinct()
    rows = asked.join(observed, ["review_id", "skill"], "left").join(hot, ["review_id", "skill"], "left")
    state = rows.groupBy("review_id").agg(F.bool_or(F.coalesce("status", F.lit("failed")) == "failed").alias("failed"), F.bool_or(F.coalesce("found", F.lit(False))).alias("found"))
    why = F.when(F.col("failed"), "FAILED_AGAIN").when(F.col("found"), "NEW_RISK")
    result = target.select("review_id").distinct().join(state, "review_id", "left").select("review_id", F.when(why.isNull(), "success").otherwise("failed").alias("status"), why.alias("failure_reason"))
    update = rows.join(result.where("status = 'success'").select("review_id"), "review_id", "left_semi")
    return result, update.select("review_id", "skill", "route_id", F.lit(True).alias("mandatory"), "status", "error_code")


#: Relations of a result, and their columns beside review_id.
RESULT = {
    "result": "given_request_id string, given_review_id long, attempt int, status string", "added": "artifact_id string, evidence_id string, finding_id string, level string, source string, detector_name string, detector_version string, file_path string, start_line long, end_line long, side string, hunk_id string, snippet_hash string, content_hash string",
    "added_link": "finding_id string, evidence_id string", "added_verified": "evidence_id string", "finding_resolution": "finding_id string, status string", "conflict_resolution": "conflict_id string", "coverage_update": "skill string, route_id string, mandatory boolean, status string, error_code string",
}


def run_once(gate: Gate, execute: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
    """Decisions after at most one recheck: (review_id, status, rule_ids, actions, reason, exit_code, attempts, exhausted).

    execute takes the targets to the relations of results (RESULT; those that are missing are empty, and a result without
    an identity is taken as that of its request). Only reviews that need a person and have targets are executed; results
    that fail or break a rule are not applied. The second gate reads the rows of the accepted reviews alone; a review that
    needs a person still has used up its recheck (N008).
    """
    target = cut(targets(gate), "targets")
    request = cut(requests(target), "requests")
    given, spark = execute(target), target.sparkSession
    told = {name: given.get(name, spark.createDataFrame([], f"review_id long, {schema}")) for name, schema in RESULT.items()}
    if "given_request_id" not in told["result"].columns:
        told["result"] = told["result"].join(request.select("review_id", F.col("request_id").alias("given_request_id")), "review_id", "left").withColumns({"given_review_id": F.col("review_id"), "attempt": F.lit(1)})
    told |= {name: cut(told[name], name) for name in given}
    wrong = cut(violations(request, target, gate.r["evidence"], gate.r["finding"], **told), "violations")
    asked = request.select("review_id")
    fine = cut(accepted(told["result"].where("status = 'success'").select("review_id"), wrong).join(asked, "review_id", "left_semi").distinct(), "accepted")
    own = lambda rows: rows.join(fine, "review_id", "left_semi")
    r = {name: own(rows) for name, rows in gate.r.items()}
    new = {name: own(rows) for name, rows in told.items()}
    found = own(gate.conflicts).join(r["conflict"].select("review_id", "conflict_id"), ["review_id", "conflict_id"], "left_anti")
    cited = F.explode(F.concat(F.transform("finding_ids", lambda f: F.struct(f.alias("finding_id"), F.lit(None).cast("string").alias("rule_id"))), F.transform("rule_ids", lambda i: F.struct(F.lit(None).cast("string").alias("finding_id"), i.alias("rule_id")))))
    supplied = r["conflict"].unionByName(found.select("review_id", "conflict_id", F.lit(1).alias("entry"), "type", "resolved", cited.alias("c")).select("review_id", "conflict_id", "entry", "type", "resolved", "c.*"), allowMissingColumns=True)
    second = Gate(gate.policy, gate.always_on, **r | {
        "finding": apply_findings(r["finding"], new["finding_resolution"]), "evidence": apply_evidence(r["evidence"], new["added"], new["added_link"], r["finding"]), "conflict": apply_conflicts(supplied, new["conflict_resolution"]),
        "link": r["link"].select("review_id", "finding_id", "evidence_id").unionByName(new["added_link"].select("review_id", "finding_id", "evidence_id")), "verified": r["verified"].select("review_id", "evidence_id").unionByName(new["added_verified"].select("review_id", "evidence_id")), "coverage": replace_coverage(r["coverage"], new["coverage_update"].groupBy("review_id", "skill").agg(F.max("status").alias("status"))),
    })
    rules = ["review_id", "rules", "failure"]
    first, again = gate.rules.select(rules), second.rules.select(rules)
    still = again.join(policy.decided(again, gate.policy).where("status = 'NEEDS_REVIEW'"), "review_id", "left_semi")
    refused = first.join(asked, "review_id", "left_semi").join(fine, "review_id", "left_anti")
    used = cut(still.select("review_id").unionByName(refused.select("review_id")), "exhausted")
    both = first.join(fine, "review_id", "left_anti").unionByName(again)
    out = policy.decided(exhausted(both, used), gate.policy)
    marks = request.select("review_id", F.lit(1).alias("attempts"))
    return out.join(marks, "review_id", "left").join(used.withColumn("exhausted", F.lit(True)), "review_id", "left").fillna(0, ["attempts"]).fillna(False, ["exhausted"])
