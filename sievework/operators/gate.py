"""The gate: one decision per review from all its records, failing closed.

Facts about evidence, findings, coverage and conflicts are made once and written to the shared folder; rules read them.
What a review's decision needs are flags, so no review's records are gathered in one place; which finding is in which
bucket is a relation of its own. Several readings of one part cost one computation.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITY_RANK, rank
from ..scratch import cut, free, gathered, kept, released
from . import assurance, policy, validation
from .routing import ALWAYS_ON

#: The relations of a gate, by name.
RELATIONS = ("review", "artifact", "lineage", "root", "finding", "place", "evidence", "link", "verified", "hunk", "route", "route_place", "coverage", "coverage_route", "coverage_file", "conflict")


def mandatory_gaps(review: DataFrame, route: DataFrame, coverage: DataFrame, covered: DataFrame, told: policy.Policy = policy.FROZEN) -> DataFrame:
    """(review_id, coverage_id, error_code, provider_failure) of incomplete mandatory coverage; an id is null where no valid record is.

    Valid records must be mandatory and completed: those marked mandatory, those of the skills that every review needs, and
    those of every skill of a mandatory route. coverage: the facts; covered: the same, once a route.
    """
    valid = coverage.where("not bad").select("review_id", "coverage_id", "skill", "mandatory", "status", "error_code")
    by = covered.where("not bad").select("review_id", "coverage_id", "skill", "route_id", "mandatory", "status", "error_code")
    done = F.col("mandatory") & (F.col("status") == "completed")
    own = valid.where("mandatory and status <> 'completed'").select("review_id", "coverage_id", "error_code")
    skills = F.explode(F.array(*map(F.lit, told.always_required)).cast("array<string>")).alias("skill")
    always = review.select("review_id").distinct().select("review_id", skills).join(valid.groupBy("review_id", "skill").agg(F.bool_and(done).alias("done")), ["review_id", "skill"], "left").where("not coalesce(done, false)")
    routed = route.where("mandatory").select("review_id", "route_id", "skill").distinct().join(by.groupBy("review_id", "route_id", "skill").agg(F.bool_and(done).alias("done")), ["review_id", "route_id", "skill"], "left").where("not coalesce(done, false)")
    by_skill = always.join(valid.select("review_id", "skill", "coverage_id", "error_code"), ["review_id", "skill"], "left")
    by_route = routed.join(by.select("review_id", "route_id", "skill", "coverage_id", "error_code"), ["review_id", "route_id", "skill"], "left")
    out = own.unionByName(by_skill.select(own.columns)).unionByName(by_route.select(own.columns)).distinct()
    return out.withColumn("provider_failure", F.coalesce(F.col("error_code").isin(told.provider_codes), F.lit(False)))


def incomplete_artifacts(review: DataFrame, artifact: DataFrame, told: policy.Policy = policy.FROZEN) -> DataFrame:
    """(review_id, schema_name, n): required artifacts that are not there exactly once, as asked for and successful."""
    none = "array<struct<schema_name:string,version:string,agent:string,role:string>>"
    asked = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("schema_name", "version", "agent", "role"), w, strict=True)]) for w in told.required_artifacts]).cast(none)).alias("w")
    wanted = review.select("review_id").distinct().select("review_id", asked).select("review_id", "w.*")
    fits = (F.col("schema_version") == F.col("version")) & (F.col("agent_id") == F.col("agent")) & (F.col("agent_role") == F.col("role")) & (F.col("status") == "success") & (F.col("own_review_id") == F.col("review_id"))
    own = wanted.join(artifact, ["review_id", "schema_name"], "left").groupBy("review_id", "schema_name").agg(F.count("artifact_id").alias("n"), F.bool_or(F.coalesce(fits, F.lit(False))).alias("fits"))
    return own.where("n <> 1 or not fits").select("review_id", "schema_name", "n")


@contextmanager
def _distinct(make: Callable[[], DataFrame]) -> Iterator[DataFrame]:
    yield make().select("review_id", "code", "subject").distinct()


def _flags(issues: DataFrame) -> DataFrame:
    """(review_id, tampered) of the reviews with issues."""
    return issues.groupBy("review_id").agg(F.bool_or(F.col("code").isin(validation.TAMPER_CODES)).alias("tampered"))


@contextmanager
def _flagged(make: Callable[[], DataFrame]) -> Iterator[DataFrame]:
    yield _flags(make())


class Gate:
    """All parts of the decisions over the relations (RELATIONS); each part is made when first asked for."""

    def __init__(self, told: policy.Policy = policy.FROZEN, always_on: list[str] = ALWAYS_ON, **relations: DataFrame) -> None:
        self.policy, self.always_on, self.r = told, always_on, relations
        self._written: list[DataFrame] = []

    def __enter__(self) -> Gate:
        return self

    def __exit__(self, *_: object) -> None:
        self.end()

    def end(self) -> None:
        """Delete the written parts: for when no result of theirs will be read again."""
        while self._written:
            free(self._written.pop())

    def _kept(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """What make gives, written once, until the gate's end; what it writes on its way goes at once."""
        with released():
            rows = make()
            with kept():
                self._written.append(cut(rows, name))
        return self._written[-1]

    def _held(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written until the gate's end or that of the open block."""
        self._written.append(cut(rows, name))
        return self._written[-1]

    def _over(self, keys: list[str], ids: DataFrame, *names: str) -> dict[str, DataFrame]:
        return {n: self.r[n].join(ids, keys, "left_semi") for n in names}

    def _part(self, relations: dict[str, DataFrame]) -> Gate:
        """A gate over other relations that ends with this one."""
        part = Gate(self.policy, self.always_on, **self.r | relations)
        part._written = self._written
        return part

    def of_reviews(self, reviews: DataFrame) -> Gate:
        """The gate over all records of some reviews (review_id, written), which are written: for few of the reviews."""
        return self._part({n: self._held(rows, n) for n, rows in self._over(["review_id"], reviews, *self.r).items()})

    def of_evidence(self, ids: DataFrame) -> Gate:
        """The gate over some evidence (review_id, evidence_id, written) and what its facts are read off; other parts are not its."""
        reviews = ids.select("review_id").distinct()
        return self._part(self._over(["review_id", "evidence_id"], ids, "evidence", "verified") | self._over(["review_id"], reviews, "hunk", "artifact"))

    def of_findings(self, ids: DataFrame) -> Gate:
        """The gate over some findings (review_id, finding_id, written) and what their facts are read off; other parts are not its."""
        own = self._over(["review_id", "finding_id"], ids, "finding", "place", "link")
        cited = self._held(own["link"].select("review_id", "evidence_id").distinct(), "cited")
        reviews = ids.select("review_id").distinct()
        return self._part(own | self._over(["review_id", "evidence_id"], cited, "evidence", "verified") | self._over(["review_id"], reviews, "hunk", "artifact"))

    @cached_property
    def evidence(self) -> DataFrame:
        return self._kept(lambda: validation.evidence_facts(self.r["evidence"], self.r["verified"], self.r["hunk"], self.r["artifact"], self.policy), "evidence")

    @cached_property
    def places(self) -> DataFrame:
        return validation.finding_places(self.r["place"], self.r["hunk"])

    @cached_property
    def pairs(self) -> DataFrame:
        """The facts of links, each once."""
        return validation.pair_facts(self.r["link"].select("review_id", "finding_id", "evidence_id").distinct(), self.places, self.evidence)

    @cached_property
    def finding(self) -> DataFrame:
        return self._kept(self._finding, "finding")

    def _finding(self) -> DataFrame:
        places = cut(self.places, "places")
        return validation.finding_facts(self.r["finding"], places, validation.pair_facts(self.r["link"], places, self.evidence), self.r["artifact"])

    @cached_property
    def judged(self) -> DataFrame:
        """What decisions read of the facts of findings, without places, evidence and subjects; codes: of the issues, repeats included."""
        wanted = ("review_id", "finding_id", "category", "severity", "status", "best_new", "invalid", "new_side", F.transform("issues", lambda i: i["code"]).alias("codes"))
        return self._kept(lambda: (self.finding if "finding" in self.__dict__ else self._finding()).select(*wanted), "judged")

    def identified(self) -> DataFrame:
        """Findings with identity: their facts where these are there, else off findings and places alone, written until the gate's end or that of the open block."""
        if "finding" in self.__dict__:
            return self.finding
        rows = validation.identified(self.r["finding"], self.r["place"])
        return self._held(rows.select("review_id", "finding_id", "status", "severity", "fingerprint", "identity"), "identified")

    def canonical_findings(self) -> DataFrame:
        """assurance.canonical_findings; where no facts are there they are made of the findings that share an identity with others, for one alone represents itself."""
        if "finding" in self.__dict__:
            return assurance.canonical_findings(self.finding)
        rows = validation.identified(self.r["finding"], self.r["place"])
        groups = self._held(rows.groupBy("review_id", "identity").agg(F.array_sort(F.collect_set("finding_id")).alias("members")).select("review_id", "members"), "alike")
        shared = self._held(groups.where("size(members) > 1").select("review_id", F.explode("members").alias("finding_id")).distinct(), "shared")
        return assurance.represented(groups).unionByName(assurance.canonical_findings(self.of_findings(shared).finding).where("size(members) > 1").select("review_id", "selected", "members"))

    def canonical_evidence(self) -> DataFrame:
        """assurance.canonical_evidence, in the way of canonical_findings."""
        if "evidence" in self.__dict__:
            return assurance.canonical_evidence(self.evidence)
        groups = self._held(assurance.alike_evidence(self.r["evidence"]).agg(F.array_sort(F.collect_set("evidence_id")).alias("members")).select("review_id", "members"), "alike")
        shared = self._held(groups.where("size(members) > 1").select("review_id", F.explode("members").alias("evidence_id")).distinct(), "shared")
        return assurance.represented(groups).unionByName(assurance.canonical_evidence(self.of_evidence(shared).evidence).where("size(members) > 1").select("review_id", "selected", "members"))

    @cached_property
    def coverage(self) -> DataFrame:
        return self._kept(lambda: validation.coverage_facts(self.r["coverage"], self.r["coverage_route"], self.r["coverage_file"], self.r["route"], self.r["hunk"], self.r["artifact"], self.policy, self.always_on), "coverage")

    @cached_property
    def covered(self) -> DataFrame:
        """Coverage, once for every route that a record names."""
        return self._kept(lambda: validation.covered_routes(self.coverage, self.r["coverage_route"]), "covered")

    @cached_property
    def gaps(self) -> DataFrame:
        return mandatory_gaps(self.r["review"], self.r["route"], self.coverage, self.covered, self.policy)

    @cached_property
    def related(self) -> DataFrame:
        return assurance.related_routes(self.r["finding"], self.r["place"], self.r["route"], self.r["route_place"])

    @cached_property
    def coverage_gaps(self) -> DataFrame:
        covered = self.covered if "covered" in self.__dict__ else validation.covered_routes(self.r["coverage"], self.r["coverage_route"])
        return assurance.coverage_gaps(self.r["route"], covered, self.related)

    @cached_property
    def conflicts(self) -> DataFrame:
        return self._kept(lambda: assurance.all_conflicts(self.identified(), self.coverage_gaps, self.r["conflict"]), "conflicts")

    def _parts(self) -> list[tuple[tuple[str, ...], Callable[[], DataFrame]]]:
        """What each group of issue codes is read off."""
        r, v = self.r, validation
        return [
            (v.EVIDENCE_CODES, lambda: v.told(self.evidence, "evidence_id")),
            (v.FINDING_CODES, lambda: v.finding_issues(self.finding)),
            (v.COVERAGE_CODES, lambda: v.told(self.coverage, "coverage_id")),
            (("PLANNED_COVERAGE_MISSING",), lambda: v.planned_coverage(r["review"], r["route"], self.coverage, self.covered, self.always_on)),
            (("ROUTE_LOCATION_INVALID",), lambda: v.route_issues(r["route_place"], r["hunk"])),
            (("DUPLICATE_ARTIFACT_ID",), lambda: v.repeated_artifacts(r["artifact"])),
            (("ARTIFACT_REVIEW_MISMATCH",), lambda: v.review_mismatches(r["artifact"])),
            (("ARTIFACT_LINEAGE_DANGLING",), lambda: v.dangling_lineage(r["lineage"], r["artifact"], r["root"])),
            (("ARTIFACT_LINEAGE_CYCLE",), lambda: v.lineage_cycles(r["lineage"])),
            (v.CONFLICT_CODES, lambda: v.conflict_issues(r["conflict"], r["finding"], self.policy)),
        ]

    def _own_parts(self) -> list[tuple[tuple[str, ...], Callable[[], DataFrame]]]:
        """What codes are read off where only some are asked for and no facts need be made."""
        r, v = self.r, validation
        return [
            (("FINDING_EVIDENCE_DANGLING",), lambda: v.dangling_links(r["finding"], r["link"], r["evidence"])),
            (("EVIDENCE_FINDING_LOCATION_MISMATCH",), lambda: v.mismatched_links(r["finding"], r["place"], r["link"], r["evidence"])),
            (("FINDING_LOCATION_INVALID",), lambda: v.misplaced_findings(r["finding"], r["place"], r["hunk"])),
            (("EVIDENCE_LOCATION_INVALID",), lambda: v.misplaced_evidence(r["evidence"], r["hunk"])),
            (("E3_PROVENANCE_UNVERIFIED",), lambda: v.unverified_evidence(r["evidence"], r["verified"])),
            (("E3_DETECTOR_NOT_ALLOWED",), lambda: v.disallowed_evidence(r["evidence"], self.policy)),
            (("VERIFIED_E3_DANGLING", "VERIFIED_E3_NOT_E3"), lambda: v.registry_issues(r["verified"], r["evidence"])),
            (("COVERAGE_ROUTE_DANGLING",), lambda: v.lost_routes(r["coverage"], r["coverage_route"], r["route"])),
            (("COVERAGE_FILE_INVALID",), lambda: v.outside_files(r["coverage"], r["coverage_file"], r["hunk"])),
        ]

    def _union(self, codes: tuple[str, ...]) -> DataFrame:
        own = [(told, make) for told, make in self._own_parts() if set(told) & set(codes)]
        rest = set(codes) - {c for told, _ in own for c in told}
        made = [make for _, make in own] + [make for told, make in self._parts() if set(told) & rest]
        return functools.reduce(DataFrame.unionByName, [make() for make in made]).distinct()

    @cached_property
    def issues(self) -> DataFrame:
        """(review_id, code, subject) of everything that is wrong. Groups of codes share no rows: they are written in turn, so that the shuffles of one are gone before the next."""
        _ = self.finding, self.coverage, self.covered  # made before, outside the parts, whose tables go with them
        with kept():
            self._written.append(gathered("issues", [functools.partial(_distinct, make) for _, make in self._parts()]))
        return self._written[-1]

    @cached_property
    def assured_issues(self) -> DataFrame:
        """Issues after assurance: of supplied conflicts that share an id the last is left, and with the detected ones is validated again."""
        own = self.issues.where(~F.col("code").isin(*validation.CONFLICT_CODES))
        return own.unionByName(self.assured_conflict_issues).distinct()

    @cached_property
    def assured_conflict_issues(self) -> DataFrame:
        """The issues of conflicts after assurance. Detected ones name known findings and rules, and of one id the supplied one stays: so these are the supplied ones' alone."""
        last = validation.last_entries(self.r["conflict"].where("review_id is not null and conflict_id is not null"))
        return validation.conflict_issues(last, self.r["finding"], self.policy).distinct()

    def issues_of(self, *codes: str) -> DataFrame:
        """The issues of some codes, off the relations that they need, or off all issues where these are there."""
        rows = self.issues if "issues" in self.__dict__ else self._union(codes)
        return rows.where(F.col("code").isin(*codes))

    @cached_property
    def marked(self) -> DataFrame:
        """Findings with blocks (rules that they match), strong (they count for the integrity block), active and level."""
        barred = assurance.disqualified(self.conflicts).withColumn("barred", F.lit(True))
        rows = self.judged.join(barred, ["review_id", "finding_id"], "left")
        usable = ~F.col("invalid") & F.col("barred").isNull() & F.col("new_side")
        level = rank(F.col("severity"), SEVERITY_RANK)
        strong = usable & (F.col("status") == "confirmed") & (level >= SEVERITY_RANK["high"]) & (F.col("best_new") >= 3)
        out = rows.select("review_id", "finding_id", "invalid", level.alias("level"), (F.col("status") != "dismissed").alias("active"), policy.block_rules(self.policy, usable).alias("blocks"), F.coalesce(strong, F.lit(False)).alias("strong"))
        return self._kept(lambda: out, "marked")

    def strong_reviews(self) -> DataFrame:
        """Reviews that alone can have strong findings, off single rows: a confirmed finding of high severity or more that names E3 evidence of the new side, allowed and registered."""
        e = validation.registered_evidence(self.r["evidence"], self.r["verified"], self.policy).where("side = 'new'")
        proven = self.r["link"].join(e.select("review_id", "evidence_id"), ["review_id", "evidence_id"], "left_semi").select("review_id", "finding_id")
        high = self.r["finding"].where((F.col("status") == "confirmed") & (rank(F.col("severity"), SEVERITY_RANK) >= SEVERITY_RANK["high"]))
        return self._held(high.join(proven, ["review_id", "finding_id"], "left_semi").select("review_id").distinct(), "strong")

    @cached_property
    def flagged(self) -> DataFrame:
        """(review_id, tampered) of the reviews with issues: off the issues where these are there, else a row a review is written of each group of codes."""
        if "issues" in self.__dict__:
            return _flags(self.issues)
        _ = self.judged, self.coverage, self.covered  # as for issues
        parts = [make for codes, make in self._parts() if codes != validation.FINDING_CODES]
        parts.append(lambda: self.judged.select("review_id", F.explode("codes").alias("code")))
        with kept():
            self._written.append(gathered("flagged", [functools.partial(_flagged, make) for make in parts]))
        return self._written[-1].groupBy("review_id").agg(F.bool_or("tampered").alias("tampered"))

    def _tampered(self) -> DataFrame:
        """flagged, where no issues are there of the reviews with strong findings alone: the others' buckets don't ask for it."""
        if self.__dict__.keys() & {"issues", "flagged"}:
            return self.flagged
        return self.of_reviews(self._held(self.marked.where("strong").select("review_id").distinct(), "strong")).flagged

    @cached_property
    def buckets(self) -> DataFrame:
        """(review_id, finding_id, bucket, rules): blocking, review or warning, and the B, N004 and N005 rules that it is named under."""
        marked = self.marked
        contested = self.conflicts.where("not resolved").select("review_id", F.explode("finding_ids").alias("finding_id"), F.lit(True).alias("contested")).distinct()
        rows = marked.join(self._tampered(), "review_id", "left").join(contested, ["review_id", "finding_id"], "left")
        own = F.concat("blocks", F.when(F.coalesce("tampered", F.lit(False)) & F.col("strong"), F.array(F.lit(policy.INTEGRITY_BLOCK))).otherwise(F.array().cast("array<string>")))
        free = F.col("active") & (F.size(own) == 0)
        by_level = F.array_compact(F.array(F.when(free & (F.col("level") >= 3), "N004"), F.when(free & (F.col("level") == 2), "N005")))
        asks = (F.size(by_level) > 0) | F.col("invalid") | F.coalesce("contested", F.lit(False))
        bucket = F.when(F.size(own) > 0, "blocking").when(asks, "review").when(F.col("active"), "warning")
        return self._kept(lambda: rows.select("review_id", "finding_id", bucket.alias("bucket"), F.concat(own, by_level).alias("rules")).where("bucket is not null").distinct(), "buckets")

    @cached_property
    def failures(self) -> DataFrame:
        """(review_id, failure) of the reviews without a trustworthy core, off the reviews alone."""
        return validation.broken_core(self.r["review"]).withColumn("failure", F.lit(policy.INPUT_FAILURE))

    @cached_property
    def rules(self) -> DataFrame:
        """One row per review: rules (ids that hold), failure, coverage_complete."""
        hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
        named = [hit(F.array_contains("blocks", rule[0])).alias(rule[0]) for rule in self.policy.block_rules]
        free, strong = F.col("active") & (F.size("blocks") == 0), F.col("strong")
        flags = self.marked.groupBy("review_id").agg(*named, hit(strong).alias("strong"), *[hit(free & s & lv).alias(n) for n, s, lv in (("high", ~strong, F.col("level") >= 3), ("high_strong", strong, F.col("level") >= 3), ("medium", F.lit(True), F.col("level") == 2))])
        gaps = self.gaps.groupBy("review_id").agg(F.lit(True).alias("N001"), F.bool_or("provider_failure").alias("N007"))
        open_ = self.conflicts.where("not resolved").select("review_id", F.lit(True).alias("N003")).distinct()
        lacking = incomplete_artifacts(self.r["review"], self.r["artifact"], self.policy).select("review_id", F.lit(True).alias("lacking")).distinct()
        broken = self.failures.withColumnRenamed("failure", "broken")
        rows = self.r["review"].select("review_id", "truncated", "unsupported", "repair_exhausted", "recheck_exhausted").dropDuplicates(["review_id"])
        for part in (flags, self.flagged.withColumn("wrong", F.lit(True)), gaps, open_, lacking, broken):
            rows = rows.join(part, "review_id", "left")
        yes = lambda name: F.coalesce(F.col(name), F.lit(False))
        b004 = yes("tampered") & yes("strong")
        held: dict[str, Column] = {rule[0]: yes(rule[0]) for rule in self.policy.block_rules} | {
            policy.INTEGRITY_BLOCK: b004, "N001": yes("N001"), "N002": yes("truncated") | yes("unsupported"), "N003": yes("N003"), "N004": yes("high") | (yes("high_strong") & ~b004), "N005": yes("medium"),
            "N006": yes("wrong") | yes("lacking") | yes("repair_exhausted"), "N007": yes("N007"), "N008": yes("recheck_exhausted"),
        }
        out = rows.select("review_id", F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in held.items()])).alias("rules"), F.col("broken").alias("failure"), (~yes("N001") & ~yes("lacking") & F.col("broken").isNull()).alias("coverage_complete"))
        return self._kept(lambda: out, "rules")

    @cached_property
    def decisions(self) -> DataFrame:
        return policy.decided(self.rules, self.policy)


def safe_gate(told: policy.Policy | None, **relations: DataFrame) -> DataFrame:
    """The decisions; FAILED for all reviews where there is no policy or the gate can't complete."""
    return policy.safe_decisions(relations["review"], told, lambda p: Gate(p, **relations).decisions)
