"""A whole review from its patch: lines, scans, routes, coverage, evidence, the gate, one recheck, the final decision.

All reviews run together; every step is a relation keyed by review_id. What models answered comes in as recorded
outcomes of the two reviewing agents; the deterministic skills run here. A patch that is too large or whose hunks
don't add up has no core, so its review fails.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from ..scratch import cut
from . import assembly, code, patch, policy, recheck, routing, scanners, secrets
from .gate import Gate

# Agents, the schema and the role of their artifacts, and the skill that each covers.
AGENTS = [("security-scanner", "Security Scanner", "SecurityReview", "security_semantic_review"), ("quality-reviewer", "Quality Reviewer", "QualityReview", "review_code_quality")]
# Versions of the detectors.
VERSIONS = {"detect_secret": "1.0.0", "detect_injection": "1.1.0", "detect_dangerous_call": "1.1.0"}
DECIDED_AT = "1970-01-01 00:00:00"


class ReviewRun:
    """The relations and decisions of (review_id, raw_diff) and outcomes (review_id, agent_id, status, error_code, repair_exhausted).

    extra: scanners of the user's own. Parts are made when first asked for; lines, hits and records are written once.
    """

    def __init__(self, patches: DataFrame, outcomes: DataFrame, told: policy.Policy = policy.FROZEN, extra: scanners.Registry | None = None, max_lines: int = patch.MAX_LINES) -> None:
        self.patches, self.outcomes, self.policy, self.extra, self.max_lines = patches, outcomes, told, extra or scanners.Registry(), max_lines

    @cached_property
    def _raw(self) -> DataFrame:
        return cut(patch.raw_lines(patch.within_bytes(self.patches)[0]), "raw")

    @cached_property
    def files(self) -> DataFrame:
        return cut(patch.files(self._raw, self.max_lines), "files")

    @cached_property
    def lines(self) -> DataFrame:
        rows = patch.source_lines(patch.numbered(self._raw), self.files, placed=True)
        return cut(rows.withColumn("line_key", F.xxhash64("hunk_id", "ordinal", "side")), "lines")

    @cached_property
    def reviews(self) -> DataFrame:
        """One row a review: whether its patch has a sound core, and its scope (C-06)."""
        broken = patch.broken_hunks(self._raw).select("review_id").unionByName(patch.within_bytes(self.patches)[1].select("review_id")).distinct().withColumn("broken", F.lit(True))
        scope = self.files.groupBy("review_id").agg(F.bool_or(F.col("exclusion_reason") == "changed_line_limit").alias("truncated"), F.bool_or(F.col("exclusion_reason").isin("binary", "unsupported_language")).alias("unsupported"))
        repair = self.outcomes.groupBy("review_id").agg(F.bool_or("repair_exhausted").alias("repair_exhausted"))
        rows = self.patches.select("review_id").distinct()
        for part in (broken, scope, repair):
            rows = rows.join(part, "review_id", "left")
        core = F.when(F.col("broken").isNull(), F.col("review_id"))
        flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("truncated", "unsupported", "repair_exhausted")]
        return cut(rows.select("review_id", stable_id("trace", F.col("review_id")).alias("trace_id"), F.lit(DECIDED_AT).cast("timestamp").alias("decided_at"), core.alias("diff_review_id"), core.alias("risk_review_id"), *flags, F.lit(False).alias("recheck_exhausted")), "reviews")

    # ---- scans and routes ----

    def observed(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(secrets seen on lines, by the rules and the user's scanners; (review_id, error_code) where a scanner failed)."""
        asked, lost = scanners.with_errors(self.extra.scan(lines, "detect_secret"))
        columns = ["review_id", "line_key", "kind", "side", "secret_type", "value", "level", "status"]
        told = asked.join(lines.select("review_id", "line_key", "kind", "side"), ["review_id", "line_key"]).select(columns)
        return secrets.observations(lines).select(columns).unionByName(told), lost

    @cached_property
    def masked(self) -> DataFrame:
        """Lines as they may be disclosed."""
        return secrets.masked_lines(self.lines, self.observed(self.lines)[0])

    def scan(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits, failures) of all deterministic skills over source lines.

        hits: (review_id, skill, rule, category, status, level, severity, confidence_pct, source, line_key); failures:
        (review_id, skill, error_code).
        """
        placed = lines.select("review_id", "line_key", "hunk_id", "side", "line_number")
        seen, lost = self.observed(lines)
        own = secrets.findings(seen).distinct()
        one = lambda skill, rule, category, severity, confidence, source: [F.lit(skill).alias("skill"), rule.alias("rule"), category.alias("category"), "status", "level", severity.alias("severity"), confidence.cast("int").alias("confidence_pct"), source.alias("source"), "line_key"]
        sure = F.when(F.col("level") == "E3", 100).otherwise(70)
        source = F.when(F.col("level") == "E3", "rule").otherwise("static_tool")
        secret = own.select("review_id", *one("detect_secret", F.concat_ws(":", "secret_type", F.substring("fingerprint", 1, 12)), F.lit("secret"), F.lit("high"), sure, source))
        found = code.detect_code(lines)
        skill = F.when(F.col("rule").startswith("CS-INJECT"), "detect_injection").otherwise("detect_dangerous_call")
        at = found.where("error_code is null").select(*[c for c in found.columns if c != "line"], F.col("line").alias("line_number")).withColumn("side", F.lit("new")).join(placed, ["review_id", "hunk_id", "side", "line_number"])
        coded = at.withColumn("skill", skill).select("review_id", "skill", "rule", "category", "status", "level", "severity", (F.col("confidence") * 100).cast("int").alias("confidence_pct"), source.alias("source"), "line_key")
        more, stuck = scanners.with_errors(self.extra.scan(lines, "detect_dangerous_call"))
        joined = more.select("review_id", *one("detect_dangerous_call", F.concat_ws(":", "scanner", "rule"), F.col("category"), F.col("severity"), F.lit(60), F.lit("static_tool")))
        failed = found.where("error_code is not null").select("review_id", F.explode(F.array(F.lit("detect_injection"), F.lit("detect_dangerous_call"))).alias("skill"), "error_code")
        failures = failed.unionByName(lost.select("review_id", F.lit("detect_secret").alias("skill"), "error_code")).unionByName(stuck.select("review_id", F.lit("detect_dangerous_call").alias("skill"), "error_code"))
        return cut(secret.unionByName(coded).unionByName(joined).distinct(), "hits"), cut(failures.groupBy("review_id", "skill").agg(F.min("error_code").alias("error_code")), "failures")

    @cached_property
    def _scanned(self) -> tuple[DataFrame, DataFrame]:
        return self.scan(self.lines)

    @cached_property
    def routes(self) -> DataFrame:
        return cut(routing.merged_routes(routing.rule_candidates(self.lines).unionByName(routing.test_gaps(self.lines))), "routes")

    @cached_property
    def plan(self) -> DataFrame:
        return cut(routing.skill_plan(self.reviews, self.routes), "plan")

    def statuses(self, failures: DataFrame) -> DataFrame:
        """(review_id, skill, status, error_code) of every planned skill."""
        agents = F.create_map(*[F.lit(x) for agent, _, _, skill in AGENTS for x in (agent, skill)])
        ran = self.outcomes.select("review_id", agents[F.col("agent_id")].alias("skill"), F.when(F.col("status") == "success", "completed").otherwise("failed").alias("status"), "error_code")
        rows = self.plan.where("planned").select("review_id", "skill")
        own = F.col("skill").isin(assembly.DETERMINISTIC)
        checked = rows.where(own).join(failures, ["review_id", "skill"], "left").withColumn("status", F.when(F.col("error_code").isNull(), "completed").otherwise("failed"))
        asked = rows.where(~own).join(ran, ["review_id", "skill"], "left")
        missing = F.col("status").isNull()
        asked = asked.select("review_id", "skill", F.coalesce("status", F.lit("failed")).alias("status"), F.when(missing, routing.MISSING_RESULT).when(F.col("status") == "failed", F.coalesce("error_code", F.lit("MODEL_ERROR"))).alias("error_code"))
        return asked.unionByName(checked.select(asked.columns))

    # ---- records ----

    def _artifact_id(self, agent: Column) -> Column:
        return stable_id("artifact", F.col("review_id"), agent)

    def _owner(self, skill: str = "skill") -> Column:
        return self._artifact_id(F.when(F.col(skill) == AGENTS[1][3], AGENTS[1][0]).otherwise(AGENTS[0][0]))

    @cached_property
    def relations(self) -> dict[str, DataFrame]:
        """What the gate decides over."""
        hits, failures = self._scanned
        planned = self.plan.where("planned").select("review_id", "skill")
        spots = self.lines.select("review_id", "line_key", "file_path", "hunk_id", "side", F.col("line_number").cast("long").alias("start_line"), F.col("line_number").cast("long").alias("end_line"), F.sha2("content", 256).alias("snippet_hash"))
        found = cut(hits.join(planned, ["review_id", "skill"], "left_semi").join(spots, ["review_id", "line_key"]).withColumn("finding_id", stable_id("finding", F.col("review_id"), F.col("skill"), F.col("rule"), F.col("line_key"))).dropDuplicates(["review_id", "finding_id"]), "found")
        versions = F.create_map(*[F.lit(x) for pair in VERSIONS.items() for x in pair])
        evidence = found.select("review_id", self._owner().alias("artifact_id"), F.concat(F.lit("e-"), "finding_id").alias("evidence_id"), "finding_id", "level", "source", F.col("skill").alias("detector_name"), versions[F.col("skill")].alias("detector_version"), "file_path", "start_line", "end_line", "side", "hunk_id", "snippet_hash", F.sha2(F.concat_ws("\0", "rule", "snippet_hash"), 256).alias("content_hash"))
        runs = assembly.artifact_or_failure(self.reviews, self.outcomes, [a[0] for a in AGENTS])
        grid = self.reviews.select("review_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("agent_id", "agent_role", "schema_name"), a)]) for a in AGENTS])).alias("a")).select("review_id", "a.*")
        artifact = grid.join(runs.select("review_id", "agent_id", "status"), ["review_id", "agent_id"], "left").select("review_id", self._artifact_id(F.col("agent_id")).alias("artifact_id"), "schema_name", F.lit("1.0.0").alias("schema_version"), "agent_id", "agent_role", F.when(F.col("status") == "success", "success").otherwise("failed").alias("status"), F.col("review_id").alias("own_review_id"))
        root = self.reviews.select("review_id", stable_id("git", F.col("review_id")).alias("root_id"))
        ways = self.routes.select("review_id", "route_id", "category", F.explode("skills").alias("skill"), "mandatory")
        records = self.statuses(failures).select("review_id", self._owner().alias("artifact_id"), stable_id("coverage", F.col("review_id"), F.col("skill")).alias("coverage_id"), "skill", "status", "error_code", F.lit(True).alias("mandatory"), F.lit(0).cast("long").alias("duration_ms"))
        records = cut(records, "records")
        hunk = self.lines.join(self.files.select("review_id", "file_id", "old_path", "new_path"), ["review_id", "file_id"]).select("review_id", "hunk_id", "old_path", "new_path").distinct()
        hunk, route_place = cut(hunk, "hunks"), cut(self.routes.select("review_id", "route_id", "line_key").join(spots, ["review_id", "line_key"]).drop("line_key"), "route_places")
        paths = patch.in_scope(self.files).select("review_id", F.col("new_path").alias("file_path")).distinct()
        return {
            "review": self.reviews, "artifact": artifact, "root": root, "lineage": artifact.select("review_id", "artifact_id").join(root, "review_id").select("review_id", "artifact_id", F.col("root_id").alias("parent_id")),
            "finding": found.select("review_id", self._owner().alias("artifact_id"), "finding_id", "category", "severity", "status", F.concat_ws(":", "rule", "line_key").alias("fingerprint"), "confidence_pct"),
            "place": found.select("review_id", "finding_id", "file_path", "hunk_id", "side", "start_line", "end_line", "snippet_hash"), "evidence": evidence, "link": evidence.select("review_id", "finding_id", "evidence_id"), "verified": assembly.verified_e3(evidence), "hunk": hunk,
            "route": ways, "route_place": route_place,
            "coverage": records, "coverage_route": records.select("review_id", "coverage_id", "skill").join(ways.select("review_id", "route_id", "skill"), ["review_id", "skill"]).select("review_id", "coverage_id", "route_id"),
            "coverage_file": records.where(F.col("skill") != "detect_secret").select("review_id", "coverage_id").join(paths, "review_id"),
            "conflict": self.reviews.limit(0).select("review_id", *[F.lit(None).cast(t).alias(c) for c, t in (("conflict_id", "string"), ("entry", "int"), ("type", "string"), ("resolved", "boolean"), ("finding_id", "string"), ("rule_id", "string"))]),
        }

    @cached_property
    def gate(self) -> Gate:
        return Gate(self.policy, **self.relations)

    def execute(self, target: DataFrame) -> dict[str, DataFrame]:
        """The deterministic executor: the skills of the targeted reviews once more, over those reviews' lines alone."""
        hits, failures = self.scan(self.lines.join(target.select("review_id").distinct(), "review_id", "left_semi"))
        result, update = recheck.rerun(target, self.statuses(failures), hits.select("review_id", "skill").distinct())
        return {"result": result, "coverage_update": update}

    @cached_property
    def decisions(self) -> DataFrame:
        """(review_id, status, rule_ids, actions, reason, exit_code, attempts, exhausted) after at most one recheck."""
        return recheck.run_once(self.gate, self.execute)
