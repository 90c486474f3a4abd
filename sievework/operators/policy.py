"""The policy as data: block rules, review rules, what a review must have; and the decision that rules lead to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EXIT_CODE, LEVEL_RANK, SEVERITY_RANK, rank
from ..scratch import cut

# Rule id, categories, statuses, least severity, least evidence level; all need the new side.
BLOCK_RULES = [("B001", ["secret"], ["confirmed"], "high", "E3"), ("B002", ["command_injection", "dangerous_call"], ["confirmed"], "high", "E3"), ("B003", ["sql_injection"], ["confirmed"], "high", "E3")]
# Rule id and the action that it asks a person for.
REVIEW_RULES = [
    ("N001", "Re-run or manually complete every mandatory check."),
    ("N002", "Reduce the diff scope or provide the missing code context."),
    ("N003", "Resolve the listed evidence conflicts before merging."),
    ("N004", "Manually validate each unresolved high-severity finding."),
    ("N005", "Review the medium-risk business semantics and expected behavior."),
    ("N006", "Repair or replace the invalid or incomplete Agent artifact."),
    ("N007", "Restore the required model or tool service and re-run the missing review."),
    ("N008", "Perform the remaining targeted checks manually; automatic recheck is exhausted."),
]
# The rule of a pass, of failures (input, policy, engine), and of the integrity block.
PASS_RULE, INPUT_FAILURE, POLICY_FAILURE, ENGINE_FAILURE, INTEGRITY_BLOCK = "P001", "F001", "F002", "F003", "B004"
VERSION = "mvp-1.0.0"
# Error codes that mean that a service failed, and skills that every review must have covered.
PROVIDER_CODES = ["MODEL_AUTH_ERROR", "MODEL_ERROR", "MODEL_QUOTA_EXCEEDED", "RATE_LIMITED", "TIMEOUT"]
ALWAYS_REQUIRED = ["detect_secret"]
# Artifacts that every review needs: schema, its version, agent, role.
REQUIRED_ARTIFACTS = [("SecurityReview", "1.0.0", "security-scanner", "Security Scanner"), ("QualityReview", "1.0.0", "quality-reviewer", "Quality Reviewer")]
# Detectors that may issue E3 evidence, as (source, detector, version).
QUALIFIERS = [("rule", "detect_secret", "1.0.0"), ("rule", "detect_injection", "1.0.0"), ("rule", "detect_injection", "1.1.0"), ("static_tool", "detect_injection", "1.0.0"), ("static_tool", "detect_injection", "1.1.0"), ("rule", "detect_dangerous_call", "1.0.0"), ("rule", "detect_dangerous_call", "1.1.0"), ("system", "policy_integrity", "1.0.0")]
# What a decision says of itself.
SAYS = {
    "BLOCK": "BLOCK: deterministic strong evidence matched ", "LEFT": "; review remains incomplete under ", "NEEDS_REVIEW": "NEEDS_REVIEW: fail-closed review conditions matched ", "PASS": "PASS: all {} mandatory checks completed with no blocking evidence.",
    INPUT_FAILURE: "FAILED: the core review context is invalid.", POLICY_FAILURE: "FAILED: the requested policy is unavailable or invalid.", ENGINE_FAILURE: "FAILED: the deterministic policy engine could not complete.",
}


@dataclass(frozen=True)
class Policy:
    """What the gate asks for; the defaults are the frozen policy."""

    version: str = VERSION
    block_rules: list = field(default_factory=lambda: BLOCK_RULES)
    review_rules: list = field(default_factory=lambda: REVIEW_RULES)
    always_required: list = field(default_factory=lambda: ALWAYS_REQUIRED)
    provider_codes: list = field(default_factory=lambda: PROVIDER_CODES)
    required_artifacts: list = field(default_factory=lambda: REQUIRED_ARTIFACTS)
    qualifiers: list = field(default_factory=lambda: QUALIFIERS)

    @classmethod
    def of(cls, told: dict) -> Policy:
        """From a policy document (sources.readers.load_policy); a missing or unknown part raises."""
        if any(told["severity_rank"].get(k) != v for k, v in SEVERITY_RANK.items()) or told["evidence_rank"] != LEVEL_RANK:
            raise ValueError("the policy's ranks are not the frozen ones")
        if told["rule_ids"] != {"pass": PASS_RULE, "input_failure": INPUT_FAILURE, "policy_failure": POLICY_FAILURE, "engine_failure": ENGINE_FAILURE, "integrity_block": INTEGRITY_BLOCK}:
            raise ValueError("the policy's rule ids are not the frozen ones")
        return cls(
            told["policy_version"],
            [(r["rule_id"], r["categories"], r["statuses"], r["min_severity"], r["min_evidence_level"]) for r in told["block_rules"]],
            [(r["rule_id"], r["manual_action"]) for r in told["needs_review_rules"]],
            told["always_required_skills"],
            told["provider_failure_error_codes"],
            [(a["schema_name"], a["schema_version"], a["agent_id"], a["agent_role"]) for a in told["required_artifacts"]],
            [(q["source"], q["detector_name"], v) for q in told["e3_qualifiers"] for v in q["detector_versions"]],
        )

    def rule_order(self) -> list[str]:
        return [r[0] for r in self.block_rules] + [INTEGRITY_BLOCK] + [r[0] for r in self.review_rules]

    def rule_ids(self) -> list[str]:
        """All rule ids that a record may name."""
        return [PASS_RULE, INPUT_FAILURE, POLICY_FAILURE, ENGINE_FAILURE, *self.rule_order()]


FROZEN = Policy()


def block_rules(policy: Policy, usable: Column) -> Column:
    """Array of the block rules that a finding matches: usable findings with new-side evidence of the level asked for."""
    level = rank(F.col("severity"), SEVERITY_RANK)
    hits = [F.when(usable & F.col("category").isin(c) & F.col("status").isin(s) & (level >= SEVERITY_RANK[sev]) & (F.col("best_new") >= LEVEL_RANK[lv]), F.lit(rule)) for rule, c, s, sev, lv in policy.block_rules]
    return F.array_compact(F.array(*hits))


def decided(reviews: DataFrame, policy: Policy = FROZEN) -> DataFrame:
    """(review_id, status, rule_ids, actions, reason, exit_code) of (review_id, rules, failure).

    rules: the rule ids that hold, in any order; failure: null, or the F rule that overrides them.
    """
    order = policy.rule_order()
    ordered = F.filter(F.array(*map(F.lit, order)), lambda r: F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), r))
    rows = reviews.withColumn("held", ordered)
    blocks, needs = F.filter("held", lambda r: r.startswith("B")), F.filter("held", lambda r: r.startswith("N"))
    status = F.when(F.col("failure").isNotNull(), "FAILED").when(F.size(blocks) > 0, "BLOCK").when(F.size(needs) > 0, "NEEDS_REVIEW").otherwise("PASS")
    rows = rows.select("*", status.alias("status"), blocks.alias("b"), needs.alias("n"))
    failed = F.col("failure").isNotNull()
    ids = F.when(failed, F.array("failure")).when(F.size("held") == 0, F.array(F.lit(PASS_RULE))).otherwise(F.col("held"))
    actions = F.create_map(*[F.lit(x) for pair in policy.review_rules for x in pair])
    named = lambda c: F.array_join(c, ", ")
    left = F.when(F.size("n") > 0, F.concat(F.lit(SAYS["LEFT"]), named("n"))).otherwise("")
    failures = F.create_map(*[F.lit(x) for r in (INPUT_FAILURE, POLICY_FAILURE, ENGINE_FAILURE) for x in (r, SAYS[r])])
    reason = F.when(failed, failures[F.col("failure")]).when(F.col("status") == "BLOCK", F.concat(F.lit(SAYS["BLOCK"]), named("b"), left, F.lit("."))).when(F.col("status") == "NEEDS_REVIEW", F.concat(F.lit(SAYS["NEEDS_REVIEW"]), named("n"), F.lit("."))).otherwise(SAYS["PASS"].format(policy.version))
    asked = F.when(failed, F.array().cast("array<string>")).otherwise(F.transform("n", lambda r: actions[r]))
    return rows.select("review_id", "status", ids.alias("rule_ids"), asked.alias("actions"), reason.alias("reason"), rank(F.col("status"), EXIT_CODE).alias("exit_code"))


def safe_decisions(reviews: DataFrame, policy: Policy | None, decide: Callable[[Policy], DataFrame]) -> DataFrame:
    """decide(policy), written; every review FAILED by F002 without a policy, and by F003 if the decisions can't be made."""
    failure = POLICY_FAILURE
    if policy is not None:
        try:
            return cut(decide(policy), "decisions")
        except Exception:  # noqa: BLE001  whatever went wrong, nothing may pass
            failure = ENGINE_FAILURE
    rows = reviews.select("review_id", F.array().cast("array<string>").alias("rules"), F.lit(failure).alias("failure")).distinct()
    return decided(rows, policy or FROZEN)
