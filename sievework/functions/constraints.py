"""Data-quality rules as data: for each kind of record, conditions in SQL that a sound row meets.

``violations`` gives the rows that break them as (rule, key), in one pass. A condition that is null counts as broken, so
rules name what may be absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A relative POSIX path without drive, backslash, NUL, empty or dot segments.
SAFE_PATH = "NOT {0} RLIKE '[\\\\\\\\:\\\\x00]|^/|//|(^|/)[.]{{0,2}}(/|$)'"


def _unique(*columns: str) -> dict[str, str]:
    return {f"{c}_unique": f"size({c}) = size(array_distinct({c}))" for c in columns}


def _safe(column: str) -> str:
    return SAFE_PATH.format(column)


def _all_safe(column: str) -> str:
    return f"forall({column}, p -> {_safe('p')})"


_ORDER = {"times": "completed_at >= started_at"}
_UTC = "{0} RLIKE '(Z|[+]00:00)$'"
_DETERMINISTIC = "array('detect_secret', 'detect_injection', 'detect_dangerous_call')"
#: Kind -> rule -> condition.
RULES: dict[str, dict[str, str]] = {
    "request": {"absolute": r"repository_path RLIKE '^(/|[A-Za-z]:[/\\\\]|\\\\\\\\)'", "line_limit": "max_changed_lines BETWEEN 1 AND 5000"},
    "location": {"end_before_start": "end_line >= start_line", "positive": "start_line > 0", "path": _safe("file_path"), "side": "side IN ('old', 'new')"},
    "file": {
        "paths": "CASE change_type WHEN 'added' THEN old_path IS NULL AND new_path IS NOT NULL WHEN 'deleted' THEN old_path IS NOT NULL AND new_path IS NULL WHEN 'modified' THEN old_path = new_path ELSE old_path <> new_path END",
        "eligibility": "analysis_eligible = (exclusion_reason IS NULL)", "binary_reason": "NOT is_binary OR exclusion_reason <=> 'binary'", **_unique("hunk_ids"), "hunks": "hunk_ids = seen_hunk_ids", "counts": "is_binary OR additions = seen_additions AND deletions = seen_deletions",
    },
    "diff": {
        "additions": "total_additions = aggregate(additions, 0L, (a, x) -> a + x)", "deletions": "total_deletions = aggregate(deletions, 0L, (a, x) -> a + x)", "changed": "changed_lines = total_additions + total_deletions",
        **_unique("file_ids", "hunk_ids", "change_intents", "affected_symbols", "unsupported_files"), "unsupported_paths": _all_safe("unsupported_files"),
    },
    "route": {**_unique("required_skills"), "located": "locations > 0", "skilled": "size(required_skills) > 0"},
    "risk": {**_unique("route_ids", "always_on"), "secret_on": "array_contains(always_on, 'detect_secret')", "planned": "planned_skill_count = size(array_union(always_on, flatten(route_skills)))"},
    "evidence": {"llm_level": "source <> 'llm' OR level IN ('E0', 'E1')", "e3_reproducible": "level <> 'E3' OR reproducible", "e3_located": "level <> 'E3' OR source = 'system' OR file_path IS NOT NULL", "confidence": "confidence BETWEEN 0 AND 1"},
    "finding": {"located": "category IN ('scope_limit', 'tool_failure') OR locations > 0", "supported": "status NOT IN ('confirmed', 'suspected') OR size(evidence_ids) > 0", **_unique("evidence_ids"), "confidence": "confidence BETWEEN 0 AND 1"},
    "coverage": {"failed_has_code": "(status = 'failed') = (error_code IS NOT NULL)", "duration": "duration_ms >= 0", **_unique("route_ids", "files_checked"), "paths": _all_safe("files_checked")},
    "artifact": {**_unique("finding_ids", "evidence_ids", "coverage_ids", "fingerprints"), "no_self_parent": "NOT array_contains(input_artifact_ids, artifact_id)", "model_has_prompt": "(model_name IS NULL) = (prompt_version IS NULL)", **_ORDER, "evidence_local": "size(array_except(cited_evidence_ids, evidence_ids)) = 0"},
    "conflict": {"references": "size(finding_ids) + size(rule_ids) >= 2", **_unique("finding_ids", "rule_ids"), "resolution": "resolved = (resolution IS NOT NULL)"},
    "decision": {
        "pass_only_p001": "status <> 'PASS' OR rule_ids = array('P001')", "block_has_b": "status <> 'BLOCK' OR exists(rule_ids, r -> r LIKE 'B%') AND forall(rule_ids, r -> r LIKE 'B%' OR r LIKE 'N%')",
        "needs_only_n": "status <> 'NEEDS_REVIEW' OR forall(rule_ids, r -> r LIKE 'N%') AND size(actions) > 0", "failed_has_f": "status <> 'FAILED' OR forall(rule_ids, r -> r LIKE 'F%')", **_unique("rule_ids"), "rules": "size(rule_ids) > 0",
    },
    "buckets": {**_unique("blocking_ids", "review_ids", "warning_ids", "indexed_ids"), "disjoint": "NOT arrays_overlap(blocking_ids, review_ids) AND NOT arrays_overlap(blocking_ids, warning_ids) AND NOT arrays_overlap(review_ids, warning_ids)", "indexed": "size(array_except(concat(blocking_ids, review_ids, warning_ids), indexed_ids)) = 0", "complete_pass": "status <> 'PASS' OR coverage_complete AND size(blocking_ids) + size(review_ids) = 0", "failed_empty": "status <> 'FAILED' OR NOT coverage_complete AND size(blocking_ids) = 0", "utc": _UTC.format("decided_at")},
    "line": {"numbers": "CASE kind WHEN 'addition' THEN old_line IS NULL AND new_line IS NOT NULL WHEN 'deletion' THEN old_line IS NOT NULL AND new_line IS NULL ELSE old_line IS NOT NULL AND new_line IS NOT NULL END"},
    "diff_artifact": {
        "changed": "changed_lines = total_additions + total_deletions", "limit_flag": "exceeds_changed_line_limit = (changed_lines > max_changed_lines)", "binary_index": "binary_files = transform(filter(files, f -> f.is_binary), f -> f.path)",
        "unsupported_index": "unsupported_files = transform(filter(files, f -> f.language = 'unknown' AND NOT f.is_binary), f -> f.path)", "target": "CASE WHEN source = 'revision_range' THEN target_revision IS NOT NULL AND target_oid IS NOT NULL ELSE target_revision IS NULL AND target_oid IS NULL END", "bytes": "raw_diff_bytes >= 1",
    },
    "manifest": _unique("dependencies", "permissions"),
    "redaction": {"mask": "NOT contains(masked_content, secret_fingerprint)"},
    "masked": {"hash": "sha2(content, 256) = content_hash", "redacted": "redacted = (source_hash <> content_hash)"},
    "view": {"unsafe_hides": "cloud_safe OR size(lines) = 0", "lines_unique": "size(lines) = size(array_distinct(transform(lines, l -> l.place)))", **_unique("redaction_ids"), "redactions": "NOT cloud_safe OR redaction_ids = array_distinct(flatten(transform(lines, l -> l.redaction_ids)))"},
    "skill_result": {
        **_ORDER, "skill": "coverage_skill = skill_name", "version": "coverage_version = skill_version", **_unique("finding_ids", "evidence_ids", "fingerprints", "verified_ids"), "evidence_local": "size(array_except(cited_evidence_ids, evidence_ids)) = 0",
        "verified_e3": "size(array_except(verified_ids, e3_ids)) = 0", "failed_empty": "status <> 'failed' OR size(finding_ids) + size(verified_ids) = 0", "failed_has_e0": "status <> 'failed' OR array_contains(levels, 'E0')",
    },
    "scan": {
        "order": f"transform(parts, p -> p.skill) = {_DETERMINISTIC}", "coverage": "coverage_ids = transform(parts, p -> p.coverage_id)", "findings": "finding_ids = flatten(transform(parts, p -> p.finding_ids))", "evidence": "evidence_ids = flatten(transform(parts, p -> p.evidence_ids))", "verified": "verified_ids = flatten(transform(parts, p -> p.verified_ids))",
        "status": "status = CASE WHEN exists(parts, p -> p.status = 'failed') THEN 'failed' WHEN exists(parts, p -> p.status IN ('partial', 'skipped')) THEN 'partial' ELSE 'success' END", "review": "view_review_id = review_id", "registered": "size(array_except(verified_ids, evidence_ids)) = 0",
    },
    "plan_entry": {"skipped": "planned OR NOT mandatory AND size(route_ids) = 0", **_unique("route_ids")},
    "plan": {**_unique("skills"), "planned": "array_sort(planned_skills) = array_sort(array_union(always_on, flatten(route_skills)))", "failure_reason": "(semantic_status = 'failed') = (semantic_failure_reason IS NOT NULL)"},
    "target": {"identified": "size(finding_ids) + size(conflict_ids) + size(skill_names) > 0", "located": "size(finding_ids) = 0 OR locations > 0", **_unique("finding_ids", "conflict_ids", "skill_names", "route_ids")},
    "recheck_result": {
        "success_without_reason": "status <> 'success' OR failure_reason IS NULL", "failure_reason": "status = 'success' OR failure_reason IS NOT NULL", "failure_empty": "status = 'success' OR size(added_ids) + size(linked_ids) + size(resolution_ids) + size(conflict_ids) + size(updated_skills) = 0",
        **_unique("added_ids", "linked_ids", "resolution_ids", "conflict_ids", "updated_skills", "verified_ids"), "attempt": "attempt = 1",
    },
    "call": {
        **_ORDER, "success_hash": "status <> 'success' OR class_name IS NULL AND response_hash IS NOT NULL", "failed_has_class": "status <> 'failed' OR class_name IS NOT NULL", "cache_within_prompt": "prompt_tokens IS NULL OR coalesce(cache_hit_tokens, 0) + coalesce(cache_miss_tokens, 0) <= prompt_tokens",
        "total": "total_tokens IS NULL OR prompt_tokens IS NULL OR completion_tokens IS NULL OR total_tokens = prompt_tokens + completion_tokens", "budget": "review_call_index BETWEEN 1 AND 4",
    },
    "run": {
        "success_has_output": "status <> 'success' OR output_kind IS NOT NULL AND failure_code IS NULL", "failure_has_none": "status = 'success' OR status = 'failed' AND output_kind IS NULL AND failure_code IS NOT NULL", "message": "(failure_code IS NULL) = (failure_message IS NULL)", "calls_own": "forall(calls, c -> c.review_id = review_id AND c.agent_id = agent_id)",
        "call_ids_unique": "size(calls) = size(array_distinct(transform(calls, c -> c.call_id)))", "output_kind": "output_kind IS NULL OR output_kind = CASE WHEN agent_id = 'diff-analyzer' THEN 'analysis' ELSE 'artifact' END", "identity": "output_agent_id IS NULL OR output_agent_id = agent_id",
    },
    "context_line": {"hash": "sha2(content, 256) = content_hash", "path": _safe("file_path"), "number": "line_number >= 1"},
    "context": {"additions": "total_additions = aggregate(additions, 0L, (a, x) -> a + x)", "deletions": "total_deletions = aggregate(deletions, 0L, (a, x) -> a + x)", "changed": "changed_lines = total_additions + total_deletions", "line_refs_unique": "size(line_refs) = size(array_distinct(line_refs))", "refs_local": "size(array_except(cited_refs, line_refs)) = 0"},
    "trace": {**_ORDER, "failed_has_code": "(status = 'failed') = (error_code IS NOT NULL)", "sequence": "sequence >= 1", "utc": _UTC.format("started_text")},
    "report": {**_ORDER, "review": "review_id = decision_review_id", "trace": "trace_id = decision_trace_id", "status": "status = decision_status", "exit_code": "exit_code = CASE status WHEN 'PASS' THEN 0 WHEN 'BLOCK' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 3 END"},
    "policy": {"precedence": "precedence = array('FAILED', 'BLOCK', 'NEEDS_REVIEW', 'PASS')", **_unique("rule_ids", "required_schemas"), "blocks": "forall(block_levels, l -> l = 'E3')", "secret_required": "array_contains(always_required, 'detect_secret')"},
    "envelope": {"ref_of_review": "startswith(input_ref, concat('shared/projects/', project, '/reviews/', review_id, '/input/'))", "path": "input_ref RLIKE '^shared(/[A-Za-z0-9_-][A-Za-z0-9_.-]*)+$'", "utc": _UTC.format("deadline_text")},
    "assignment": {
        "skill": "skill_name = concat(project, CASE role WHEN 'diff_analyzer' THEN '-diff-review' WHEN 'security_scanner' THEN '-security-review' ELSE '-quality-review' END)", "context": "context_ref = concat('shared/tasks/', task_id, '/base/role-context.json')",
        "delivery": "delivery_ref = concat('shared/tasks/', task_id, '/workspace/delivery.json')", "attempt": "attempt BETWEEN 1 AND 2",
    },
    "delivery": {**_unique("input_refs", "evidence_ids"), **_ORDER, "evidence_refs": "size(array_except(evidence_input_refs, input_refs)) = 0", "calls": "model_calls BETWEEN 0 AND 1", "control_bytes": "octet_length(message) <= 4096"},
    "draft": {**_unique("change_intents", "affected_symbols", "line_refs"), "line_limit": "size(line_refs) BETWEEN 1 AND 5", "findings_limit": "findings <= 10", "confidence": "confidence BETWEEN 0 AND 1"},
    "context_metadata": {**_unique("changed_files", "unsupported_files", "line_refs", "evidence_levels", "coverage_skills"), "paths": _all_safe("changed_files"), "coverage_code": "forall(coverage, c -> (c.status = 'failed') = (c.error_code IS NOT NULL))", "frozen_coverage": f"array_sort(coverage_skills) = array_sort({_DETERMINISTIC})", "sources": "size(source_ids) = CASE WHEN role = 'security_scanner' THEN 2 ELSE 1 END"},
    "package": {
        "paths": _all_safe("paths"), "sorted": "paths = array_sort(paths)", **_unique("paths"), "revision_in_ref": "contains(runtime_ref, concat('/', source_revision, '/'))", "ref": "startswith(runtime_ref, concat('shared/projects/', project, '/runtime/')) AND endswith(runtime_ref, '.pyz')",
        "tree": """sha2(concat('{"algorithm":"', algorithm, '","files":[', array_join(transform(arrays_zip(paths, digests), f -> concat('{"path":"', f.paths, '","sha256":"', f.digests, '"}')), ','), ']}\\n'), 256) = tree_sha256""",
    },
    "text": {"identifier": "id RLIKE '^[a-z0-9][a-z0-9-]*$' AND length(id) BETWEEN 3 AND 128", "line_ref": "line_ref RLIKE '^[A-Za-z0-9][A-Za-z0-9._:-]*$' AND length(line_ref) BETWEEN 3 AND 256", "sha256": "sha256 RLIKE '^[0-9a-f]{64}$'", "revision": "revision RLIKE '^[0-9a-f]{40}$'", "utc": _UTC.format("at")},
}


def violations(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(rule, key) for every rule of the kind whose condition is not true for a row."""
    named = [F.when(~F.coalesce(F.expr(ok), F.lit(False)), F.lit(rule)) for rule, ok in RULES[kind].items()]
    return rows.select(F.explode(F.array_compact(F.array(*named))).alias("rule"), F.col(key).alias("key"))
