"""Risk routing: rule routes on added lines, test gaps, semantic hints, merged routes, the skill plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITY_RANK, is_language_python, is_test_path, rank, stable_id

# Category, severity, reason, pattern on an added line, whether the path is tried too.
ROUTE_RULES = [
    ("sql_injection", "high", "Database query construction changed and requires injection analysis.", r"(?i)\b(?:execute|executemany|raw|query)\s*\(|\b(?:SELECT|INSERT|UPDATE|DELETE)\b", False),
    ("command_injection", "high", "Command execution surface changed and requires injection and dangerous-call checks.", r"\b(?:os\.system|os\.popen|subprocess\.|shell\s*=\s*True)", False),
    ("dangerous_call", "high", "A dangerous execution or deserialization API changed.", r"\b(?:eval|exec|pickle\.loads?|yaml\.load)\s*\(", False),
    ("auth_boundary", "high", "Authentication or authorization boundary logic changed.", r"(?i)\b(?:auth|authorize|permission|is_admin|role|access[_-]?control|jwt|token)\b", True),
    ("performance", "medium", "A loop, blocking call, or broad data access may affect performance.", r"(?i)^\s*(?:for|while)\b|\b(?:sleep|select\s+\*|\.all\(\)|N\+1)\b", False),
    ("exception_handling", "medium", "Broad exception handling changed and requires semantic review.", r"^\s*except(?:\s+Exception)?\s*:", False),
    ("logic", "medium", "Control-flow or return semantics changed.", r"^\s*(?:if|elif|return)\b", False),
]
# Category, severity, pattern on the analysis text, pattern on path and line.
HINT_SPECS = [
    ("sql_injection", "high", r"\b(sql|query|database|cursor)\b", r"(?i)\b(sql|query|execute|cursor|select|insert|update|delete)\b"),
    ("command_injection", "high", r"\b(shell|command|subprocess|process execution)\b", r"(?i)\b(shell|command|subprocess|os\.system|os\.popen)\b"),
    ("auth_boundary", "high", r"\b(auth|authorization|permission|role|access control)\b", r"(?i)\b(auth|authorize|permission|role|is_admin|token)\b"),
    ("exception_handling", "medium", r"\b(exception|error handling|failure handling)\b", r"(?i)\b(try|except|raise|error|exception)\b"),
    ("performance", "medium", r"\b(performance|latency|n\+1|slow|loop)\b", r"(?i)\b(for|while|all|sleep|query|request)\b"),
    ("test_gap", "medium", r"\b(test gap|missing test|regression test|untested)\b", r"(?i)\b(test|assert|branch|return)\b"),
]
# Why a test gap and a hint are routed.
TEST_GAP_REASON = "Production Python changed without a corresponding test-file change."
HINT_REASON, DEFAULT_HINT_REASON = "Diff Analyzer semantics requested bounded follow-up for {}.", "Diff Analyzer semantics were used to focus quality review."
# Skills of every plan, and the universe in its order.
ALWAYS_ON = ["detect_secret", "security_semantic_review", "review_code_quality"]
UNIVERSE = ["detect_secret", "security_semantic_review", "review_code_quality", "detect_injection", "detect_dangerous_call"]
# The skills that a category asks for.
SKILLS = {
    "secret": ["detect_secret", "security_semantic_review"],
    "sql_injection": ["detect_injection", "security_semantic_review"],
    "command_injection": ["detect_injection", "detect_dangerous_call", "security_semantic_review"],
    "dangerous_call": ["detect_dangerous_call", "security_semantic_review"],
    "auth_boundary": ["security_semantic_review", "review_code_quality"],
    "logic": ["review_code_quality"],
    "exception_handling": ["review_code_quality"],
    "performance": ["review_code_quality"],
    "test_gap": ["review_code_quality"],
    "scope_limit": ["security_semantic_review", "review_code_quality"],
    "tool_failure": ["security_semantic_review", "review_code_quality"],
}
# Why a skill is or is not in the plan.
PLAN_REASONS = {"always": "Always-on coverage required by the frozen MVP trust boundary.", "routed": "A deterministic risk route requires this Skill.", "skipped": "No changed line matched this Skill's frozen risk triggers."}
MISSING_RESULT = "MISSING_EXECUTION_RESULT"


def added(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'addition' and side = 'new'")


def rule_candidates(lines: DataFrame) -> DataFrame:
    """(review_id, category, severity, line_key, file_path, route_source, reason): one row for each added line and rule that matches it."""
    hits = [F.when(F.col("content").rlike(p) | (F.col("file_path").rlike(p) if path else F.lit(False)), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(why).alias("reason"))) for c, s, why, p, path in ROUTE_RULES]
    rows = added(lines).select("review_id", "line_key", "pos", "file_path", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return rows.select("review_id", "h.category", "h.severity", "line_key", "file_path", F.lit("rule").alias("route_source"), "h.reason")


def test_gaps(lines: DataFrame) -> DataFrame:
    """Reviews whose changed Python files are none of tests; at the first new-side line of a file that is not a test's."""
    python, test = is_language_python(F.col("file_path")), is_test_path(F.col("file_path"))
    first = F.min_by(F.struct("line_key", "file_path"), F.when((F.col("side") == "new") & ~test, F.col("pos")))
    groups = lines.groupBy("review_id").agg(F.bool_or(python & ~test).alias("production"), F.bool_or(python & test).alias("tested"), first.alias("l"))
    out = groups.where("production and not tested and l is not null")
    return out.select("review_id", F.lit("test_gap").alias("category"), F.lit("low").alias("severity"), "l.line_key", "l.file_path", F.lit("rule").alias("route_source"), F.lit(TEST_GAP_REASON).alias("reason"))


def semantic_hints(lines: DataFrame, analysis: DataFrame) -> DataFrame:
    """Hints from (review_id, summary): each firing spec at its first matching added line, else the first added line."""
    rows = added(lines)
    specs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(HINT_REASON.format(c)).alias("reason"), F.lower("summary").rlike(t).alias("fires")) for n, (c, s, t, _) in enumerate(HINT_SPECS)])
    fired = analysis.select("review_id", F.filter(specs, lambda x: x["fires"]).alias("f"))
    fallback = F.array(F.struct(F.lit(-1).alias("n"), F.lit("logic").alias("category"), F.lit("low").alias("severity"), F.lit(DEFAULT_HINT_REASON).alias("reason"), F.lit(True).alias("fires")))
    fired = fired.select("review_id", F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(fallback)).alias("f")).select("review_id", "f.n", "f.category", "f.severity", "f.reason")
    where = F.concat_ws("\n", "file_path", "content")
    match = F.lit(False)
    for n, (*_, pattern) in enumerate(HINT_SPECS):
        match = match | ((F.col("n") == n) & where.rlike(pattern))
    picked = rows.join(fired, "review_id").groupBy("review_id", "category", "severity", "reason").agg(F.min_by(F.struct("line_key", "file_path"), F.struct(~match, "pos")).alias("l"))
    return picked.select("review_id", "category", "severity", "l.line_key", "l.file_path", F.lit("llm").alias("route_source"), "reason")


def misplaced_hints(hint: DataFrame, lines: DataFrame) -> DataFrame:
    """Reviews with a hint at a line that is not among the disclosed ones: routing refuses them."""
    return hint.join(lines.select("review_id", "line_key", "file_path"), ["review_id", "line_key", "file_path"], "left_anti").select("review_id").distinct()


def merged_routes(candidates: DataFrame) -> DataFrame:
    """One route for each category and line: highest severity, where it came from, all reasons, the category's skills."""
    best = F.max_by("severity", rank(F.col("severity"), SEVERITY_RANK))
    source = F.when(F.count_distinct("route_source") > 1, "hybrid").otherwise(F.min("route_source"))
    skills = F.create_map(*[x for c, s in SKILLS.items() for x in (F.lit(c), F.array(*map(F.lit, s)))])
    out = candidates.groupBy("review_id", "category", "line_key", "file_path").agg(best.alias("severity"), source.alias("route_source"), F.array_join(F.array_sort(F.collect_set("reason")), " ").alias("reason"))
    return out.withColumns({"skills": skills[F.col("category")], "mandatory": F.lit(True), "route_id": stable_id("route", F.col("review_id"), F.col("category"), F.col("file_path"), F.col("line_key"))})


def ordered_routes(route: DataFrame) -> DataFrame:
    """Routes with their place in the review: by category, then file and line."""
    return route.withColumn("place", F.row_number().over(W.partitionBy("review_id").orderBy("category", "file_path", "line_key")))


def skill_plan(reviews: DataFrame, routes: DataFrame) -> DataFrame:
    """(review_id, skill, planned, mandatory, routes, reason) over the whole universe; what is planned is mandatory."""
    wanted = routes.select("review_id", "route_id", F.explode("skills").alias("skill")).groupBy("review_id", "skill").agg(F.count_distinct("route_id").alias("routes"))
    grid = reviews.select("review_id").distinct().select("review_id", F.explode(F.array(*map(F.lit, UNIVERSE))).alias("skill"))
    out = grid.join(wanted, ["review_id", "skill"], "left").fillna(0, ["routes"])
    always = F.col("skill").isin(ALWAYS_ON)
    planned = always | (F.col("routes") > 0)
    why = F.when(always, PLAN_REASONS["always"]).when(planned, PLAN_REASONS["routed"]).otherwise(PLAN_REASONS["skipped"])
    return out.select("review_id", "skill", planned.alias("planned"), planned.alias("mandatory"), "routes", why.alias("reason"))


def semantic_status(reviews: DataFrame, hint: DataFrame, failure: DataFrame) -> DataFrame:
    """(review_id, semantic_status, model_used): failed where the analysis failed, success with hints, else not requested."""
    rows = reviews.select("review_id").distinct().join(hint.select("review_id", F.lit(True).alias("hinted")).distinct(), "review_id", "left").join(failure.select("review_id", F.lit(True).alias("failed")).distinct(), "review_id", "left")
    status = F.when(F.col("failed"), "failed").when(F.col("hinted"), "success").otherwise("not_requested")
    return rows.select("review_id", status.alias("semantic_status"), (status != "not_requested").alias("model_used"))


def fallback_plan(reviews: DataFrame) -> DataFrame:
    """The plan of reviews whose routing failed: the always-on skills alone, without routes."""
    none = reviews.select("review_id", F.lit(None).cast("string").alias("route_id"), F.array().cast("array<string>").alias("skills")).limit(0)
    return skill_plan(reviews, none)


def reconcile_coverage(plan: DataFrame, coverage: DataFrame) -> DataFrame:
    """(review_id, skill, status, error_code): executed coverage of planned skills, a failed row where it is missing, a skipped row for the rest."""
    own = coverage.groupBy("review_id", "skill").agg(F.max_by(F.struct("status", "error_code"), F.when(F.col("status") == "failed", 2).when(F.col("status") == "skipped", 1).otherwise(0)).alias("c"))
    out = plan.join(own, ["review_id", "skill"], "left")
    missing = F.col("planned") & F.col("c").isNull()
    return out.select("review_id", "skill", F.when(~F.col("planned"), "skipped").when(missing, "failed").otherwise(F.col("c.status")).alias("status"), F.when(missing, MISSING_RESULT).when(F.col("planned"), F.col("c.error_code")).alias("error_code"))


def unplanned_coverage(plan: DataFrame, coverage: DataFrame) -> DataFrame:
    """Executed coverage of skills outside the plan: a reason to reject."""
    return coverage.join(plan.where("planned").select("review_id", "skill"), ["review_id", "skill"], "left_anti").select("review_id", "coverage_id", "skill")
