"""A query for every kind of record that has rules: sound rows from the orders, one fault each here and there.

Row k of a kind is sound but for the fault whose number is k modulo one more than the number of faults. The SQL says which
rules that fault must break; nothing else may be reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constraints
from .registry import add

_T0, _T1 = "timestamp '2026-01-01 00:00:00'", "timestamp '2026-01-01 00:00:05'"
_TIMES = {"started_at": _T0, "completed_at": _T1}
_LATE = {"started_at": _T1, "completed_at": _T0}
_NO_TEXT = "cast(array() as array<string>)"


def _list(*values: str) -> str:
    return f"array({', '.join(repr(v) for v in values)})" if values else _NO_TEXT


_ONE, _TWICE = _list("a", "b"), _list("a", "a")
_FILE = dict(change_type="'modified'", old_path="'src/a.py'", new_path="'src/a.py'", hunk_ids=_ONE, seen_hunk_ids=_ONE, is_binary="false", analysis_eligible="true", exclusion_reason="cast(null as string)", additions="2", deletions="1", seen_additions="2", seen_deletions="1")
_PARTS = "array({})".format(", ".join(f"named_struct('skill', '{s}', 'coverage_id', 'c{i}', 'finding_ids', array('f{i}'), 'evidence_ids', array('e{i}'), 'verified_ids', {_NO_TEXT if i else _list('e0')}, 'status', 'success')" for i, s in enumerate(("detect_secret", "detect_injection", "detect_dangerous_call"))))
_CALLS = "array(named_struct('review_id', key, 'agent_id', 'diff-analyzer', 'call_id', 'c1'), named_struct('review_id', key, 'agent_id', 'diff-analyzer', 'call_id', 'c2'))"
_TREE = """sha2('{"algorithm":"x","files":[{"path":"a/b.py","sha256":"0"},{"path":"c.py","sha256":"1"}]}\\n', 256)"""

#: Kind -> (columns of a sound row, faults); a fault: (the rules that it breaks, the columns that it changes).
FAULTS: dict[str, tuple[dict[str, str], list[tuple[tuple[str, ...], dict[str, str]]]]] = {
    "q03_request": (dict(repository_path="CASE WHEN key % 2 = 0 THEN '/srv/repo' ELSE 'C:/repo' END", max_changed_lines="1000"), [(("absolute",), dict(repository_path="'repo'")), (("line_limit",), dict(max_changed_lines="0"))]),
    "q04_location": (dict(file_path="'src/a.py'", start_line="3", end_line="4", side="'new'"), [(("end_before_start",), dict(end_line="2")), (("positive",), dict(start_line="0")), (("path",), dict(file_path="'src/../a.py'")), (("path",), dict(file_path="'/src/a.py'")), (("side",), dict(side="'left'"))]),
    "q05_q17_file": (_FILE, [
        (("paths",), dict(change_type="'added'")), (("paths",), dict(change_type="'deleted'")), (("paths",), dict(change_type="'renamed'")), (("paths",), dict(new_path="'src/b.py'")), (("eligibility",), dict(analysis_eligible="false")), (("counts",), dict(seen_additions="3")), (("hunks",), dict(seen_hunk_ids=_list("b", "a"))),
        (("hunk_ids_unique",), dict(hunk_ids=_TWICE, seen_hunk_ids=_TWICE)), (("eligibility", "binary_reason"), dict(is_binary="true", exclusion_reason="'changed_line_limit'")),
    ]),
    "q06_diff": (dict(additions="array(2L, 3L)", deletions="array(1L, 0L)", total_additions="5L", total_deletions="1L", changed_lines="6L", file_ids=_ONE, hunk_ids=_ONE, change_intents=_list(), affected_symbols=_ONE, unsupported_files=_list("a/b.md")), [
        (("additions", "changed"), dict(total_additions="4L")), (("deletions", "changed"), dict(total_deletions="2L")), (("changed",), dict(changed_lines="7L")), (("file_ids_unique",), dict(file_ids=_TWICE)), (("hunk_ids_unique",), dict(hunk_ids=_TWICE)), (("change_intents_unique",), dict(change_intents=_TWICE)), (("affected_symbols_unique",), dict(affected_symbols=_TWICE)), (("unsupported_paths",), dict(unsupported_files=_list("a//b"))),
    ]),
    "q07_route": (dict(required_skills=_ONE, locations="1"), [(("required_skills_unique",), dict(required_skills=_TWICE)), (("located",), dict(locations="0")), (("skilled",), dict(required_skills=_list()))]),
    "q08_risk": (dict(route_ids=_ONE, always_on=_list("detect_secret", "x"), route_skills="array(array('x', 'y'), array('z'))", planned_skill_count="4"), [(("route_ids_unique",), dict(route_ids=_TWICE)), (("secret_on",), dict(always_on=_list("w", "x"))), (("planned",), dict(planned_skill_count="3")), (("always_on_unique",), dict(always_on=_list("detect_secret", "x", "x")))]),
    "q09_evidence": (dict(source="'rule'", level="'E3'", reproducible="true", file_path="'a.py'", confidence="0.5"), [(("llm_level",), dict(source="'llm'", level="'E2'")), (("e3_reproducible",), dict(reproducible="false")), (("e3_located",), dict(file_path="cast(null as string)")), (("confidence",), dict(confidence="1.5"))]),
    "q10_finding": (dict(category="'logic'", locations="1", status="'suspected'", evidence_ids=_ONE, confidence="1.0"), [(("located",), dict(locations="0")), (("supported",), dict(evidence_ids=_list())), (("evidence_ids_unique",), dict(evidence_ids=_TWICE)), (("confidence",), dict(confidence="-0.1")), ((), dict(category="'tool_failure'", locations="0")), ((), dict(status="'dismissed'", evidence_ids=_list()))]),
    "q11_coverage": (dict(status="'failed'", error_code="'TIMEOUT'", duration_ms="0", route_ids=_ONE, files_checked=_list("a.py", "b/c.py")), [(("failed_has_code",), dict(error_code="cast(null as string)")), (("failed_has_code",), dict(status="'completed'")), (("duration",), dict(duration_ms="-1")), (("route_ids_unique",), dict(route_ids=_TWICE)), (("files_checked_unique",), dict(files_checked=_list("a.py", "a.py"))), (("paths",), dict(files_checked=_list("a.py", "/b")))]),
    "q12_artifact": (dict(artifact_id="'a1'", finding_ids=_ONE, evidence_ids=_ONE, coverage_ids=_ONE, fingerprints=_ONE, input_artifact_ids=_list("a0"), model_name="'m'", prompt_version="'p'", cited_evidence_ids=_list("b"), **_TIMES), [
        (("finding_ids_unique",), dict(finding_ids=_TWICE)), (("evidence_ids_unique",), dict(evidence_ids=_list("b", "b"))), (("coverage_ids_unique",), dict(coverage_ids=_TWICE)), (("fingerprints_unique",), dict(fingerprints=_TWICE)), (("no_self_parent",), dict(input_artifact_ids=_list("a0", "a1"))), (("model_has_prompt",), dict(prompt_version="cast(null as string)")), (("times",), _LATE), (("evidence_local",), dict(cited_evidence_ids=_list("b", "z"))),
    ]),
    "q13_conflict": (dict(finding_ids=_ONE, rule_ids=_list(), resolved="false", resolution="cast(null as string)"), [(("references",), dict(finding_ids=_list("a"))), (("finding_ids_unique",), dict(finding_ids=_TWICE)), (("rule_ids_unique",), dict(rule_ids=_TWICE)), (("resolution",), dict(resolved="true")), (("resolution",), dict(resolution="'done'")), ((), dict(finding_ids=_list("a"), rule_ids=_list("N001")))]),
    "q14_buckets": (dict(status="'PASS'", blocking_ids=_list(), review_ids=_list(), warning_ids=_list("w"), indexed_ids=_list("w", "x", "y"), coverage_complete="true", decided_at="'2026-01-01T00:00:00Z'"), [
        (("warning_ids_unique",), dict(warning_ids=_list("w", "w"))), (("disjoint",), dict(status="'BLOCK'", blocking_ids=_list("w"))), (("indexed",), dict(warning_ids=_list("z"))), (("complete_pass",), dict(coverage_complete="false")), (("failed_empty",), dict(status="'FAILED'")), (("utc",), dict(decided_at="'2026-01-01T00:00:00+01:00'")), (("complete_pass",), dict(review_ids=_list("x"))), (("indexed_ids_unique",), dict(indexed_ids=_list("w", "w"))),
    ]),
    "q15_line": (dict(kind="'context'", old_line="1", new_line="2"), [(("numbers",), dict(kind="'addition'")), (("numbers",), dict(kind="'deletion'")), (("numbers",), dict(old_line="cast(null as int)")), ((), dict(kind="'addition'", old_line="cast(null as int)"))]),
    "q18_diff_artifact": (dict(files="array(named_struct('path', 'a.py', 'language', 'python', 'is_binary', false), named_struct('path', 'b.bin', 'language', 'unknown', 'is_binary', true), named_struct('path', 'c.md', 'language', 'unknown', 'is_binary', false))", binary_files=_list("b.bin"), unsupported_files=_list("c.md"), total_additions="4", total_deletions="1", changed_lines="5", max_changed_lines="5", exceeds_changed_line_limit="false", source="'revision_range'", target_revision="'main'", target_oid="'0'", raw_diff_bytes="9"), [
        (("changed",), dict(total_additions="3")), (("limit_flag",), dict(max_changed_lines="4")), (("binary_index",), dict(binary_files=_list())), (("unsupported_index",), dict(unsupported_files=_list("b.bin", "c.md"))), (("target",), dict(target_oid="cast(null as string)")), (("target",), dict(source="'worktree'")), (("bytes",), dict(raw_diff_bytes="0")),
    ]),
    "q19_manifest": (dict(dependencies=_list(), permissions=_ONE), [(("dependencies_unique",), dict(dependencies=_TWICE)), (("permissions_unique",), dict(permissions=_TWICE))]),
    "q20_redaction": (dict(secret_fingerprint="sha2(cast(key as string), 256)", masked_content="concat('x = <REDACTED:T:', left(sha2(cast(key as string), 256), 12), '>')"), [(("mask",), dict(masked_content="concat('x = ', sha2(cast(key as string), 256))"))]),
    "q21_masked": (dict(content="concat('line ', key)", content_hash="sha2(concat('line ', key), 256)", source_hash="sha2(concat('line ', key), 256)", redacted="false"), [(("hash", "redacted"), dict(content_hash="sha2('other', 256)")), (("redacted",), dict(redacted="true")), (("redacted",), dict(source_hash="sha2('other', 256)")), ((), dict(source_hash="sha2('other', 256)", redacted="true"))]),
    "q22_view": (dict(cloud_safe="true", lines="array(named_struct('place', 'a:1', 'redaction_ids', array('r2')), named_struct('place', 'a:2', 'redaction_ids', array('r1', 'r2')))", redaction_ids=_list("r2", "r1")), [
        (("unsafe_hides",), dict(cloud_safe="false")), (("redactions",), dict(redaction_ids=_list("r1", "r2"))), (("redaction_ids_unique", "redactions"), dict(redaction_ids=_list("r2", "r1", "r1"))), (("lines_unique",), dict(lines="array(named_struct('place', 'a:1', 'redaction_ids', array('r2')), named_struct('place', 'a:1', 'redaction_ids', array('r1', 'r2')))")),
    ]),
    "q23_skill_result": (dict(skill_name="'detect_secret'", skill_version="'1.0.0'", coverage_skill="'detect_secret'", coverage_version="'1.0.0'", finding_ids=_list("f"), evidence_ids=_ONE, fingerprints=_list("p"), verified_ids=_list("a"), cited_evidence_ids=_list("b"), e3_ids=_list("a"), status="'success'", levels=_list("E3", "E1"), **_TIMES), [
        (("times",), _LATE), (("skill",), dict(coverage_skill="'other'")), (("version",), dict(coverage_version="'2'")), (("finding_ids_unique",), dict(finding_ids=_TWICE)), (("evidence_ids_unique",), dict(evidence_ids=_list("a", "b", "b"))), (("fingerprints_unique",), dict(fingerprints=_TWICE)), (("evidence_local",), dict(cited_evidence_ids=_list("z"))), (("verified_e3",), dict(verified_ids=_list("b"))),
        (("failed_empty", "failed_has_e0"), dict(status="'failed'")), ((), dict(status="'failed'", finding_ids=_list(), verified_ids=_list(), levels=_list("E0"))), (("verified_ids_unique",), dict(verified_ids=_TWICE)),
    ]),
    "q24_scan": (dict(parts=_PARTS, coverage_ids=_list("c0", "c1", "c2"), finding_ids=_list("f0", "f1", "f2"), evidence_ids=_list("e0", "e1", "e2"), verified_ids=_list("e0"), status="'success'", review_id="key", view_review_id="key"), [
        (("order",), dict(parts=_PARTS.replace("detect_injection", "detect_other"))), (("coverage",), dict(coverage_ids=_list("c1", "c0", "c2"))), (("findings",), dict(finding_ids=_list("f0"))), (("evidence",), dict(evidence_ids=_list("e0", "e2", "e1"))), (("verified", "registered"), dict(verified_ids=_list("z"))), (("status",), dict(status="'partial'")), (("review",), dict(view_review_id="key + 1")), ((), dict(parts=_PARTS.replace("'success'", "'skipped'"), status="'partial'")), ((), dict(parts=_PARTS.replace("'success'", "'failed'"), status="'failed'")),
    ]),
    "q25_plan_entry": (dict(planned="true", mandatory="true", route_ids=_ONE), [(("skipped",), dict(planned="false")), (("route_ids_unique",), dict(route_ids=_TWICE)), ((), dict(planned="false", mandatory="false", route_ids=_list()))]),
    "q25_plan": (dict(skills=_list("s", "x", "y"), planned_skills=_list("x", "s"), always_on=_list("s"), route_skills="array(array('x'), array('s', 'x'))", semantic_status="'success'", semantic_failure_reason="cast(null as string)"), [(("skills_unique",), dict(skills=_TWICE)), (("planned",), dict(planned_skills=_list("s", "x", "y"))), (("planned",), dict(planned_skills=_list("s"))), (("failure_reason",), dict(semantic_status="'failed'")), (("failure_reason",), dict(semantic_failure_reason="'r'"))]),
    "q26_target": (dict(finding_ids=_list("f"), conflict_ids=_list(), skill_names=_list(), route_ids=_list(), locations="1"), [(("identified",), dict(finding_ids=_list())), (("located",), dict(locations="0")), (("finding_ids_unique",), dict(finding_ids=_TWICE)), ((), dict(finding_ids=_list(), skill_names=_list("s"), locations="0")), (("route_ids_unique",), dict(route_ids=_TWICE))]),
    "q27_recheck_result": (dict(status="'success'", failure_reason="cast(null as string)", added_ids=_ONE, linked_ids=_ONE, resolution_ids=_ONE, conflict_ids=_ONE, updated_skills=_ONE, verified_ids=_ONE, attempt="1"), [
        (("success_without_reason",), dict(failure_reason="'r'")), (("failure_reason", "failure_empty"), dict(status="'failed'")), (("failure_empty",), dict(status="'timed_out'", failure_reason="'r'")), *[((f"{c}_unique",), {c: _TWICE}) for c in ("added_ids", "linked_ids", "resolution_ids", "conflict_ids", "updated_skills", "verified_ids")], (("attempt",), dict(attempt="2")),
        ((), dict(status="'failed'", failure_reason="'r'", added_ids=_list(), linked_ids=_list(), resolution_ids=_list(), conflict_ids=_list(), updated_skills=_list())),
    ]),
    "q28_call": (dict(status="'success'", class_name="cast(null as string)", response_hash="'h'", prompt_tokens="10", cache_hit_tokens="4", cache_miss_tokens="6", completion_tokens="5", total_tokens="15", review_call_index="4", **_TIMES), [
        (("times",), _LATE), (("success_hash",), dict(response_hash="cast(null as string)")), (("success_hash",), dict(class_name="'X'")), (("failed_has_class",), dict(status="'failed'")), (("cache_within_prompt",), dict(cache_hit_tokens="5")), (("total",), dict(total_tokens="16")), (("budget",), dict(review_call_index="5")), ((), dict(prompt_tokens="cast(null as int)", cache_hit_tokens="cast(null as int)")),
    ]),
    "q29_run": (dict(review_id="key", agent_id="'diff-analyzer'", status="'success'", output_kind="'analysis'", output_agent_id="cast(null as string)", failure_code="cast(null as string)", failure_message="cast(null as string)", calls=_CALLS), [
        (("success_has_output",), dict(output_kind="cast(null as string)")), (("failure_has_none",), dict(status="'failed'")), (("failure_has_none",), dict(status="'partial'")), (("success_has_output", "message"), dict(failure_code="'X'")), (("calls_own",), dict(calls=_CALLS.replace("'diff-analyzer'", "'other'"))), (("call_ids_unique",), dict(calls=_CALLS.replace("'c2'", "'c1'"))), (("output_kind",), dict(output_kind="'artifact'")), (("identity",), dict(output_agent_id="'other'")),
        ((), dict(status="'failed'", output_kind="cast(null as string)", failure_code="'X'", failure_message="'m'")),
    ]),
    "q30_context_line": (dict(content="concat('line ', key)", content_hash="sha2(concat('line ', key), 256)", file_path="'a/b.py'", line_number="1"), [(("hash",), dict(content_hash="sha2('x', 256)")), (("path",), dict(file_path="'a/./b.py'")), (("number",), dict(line_number="0"))]),
    "q31_context": (dict(additions="array(2L, 3L)", deletions="array(1L)", total_additions="5L", total_deletions="1L", changed_lines="6L", line_refs=_ONE, cited_refs=_list("b")), [(("additions", "changed"), dict(total_additions="6L")), (("deletions", "changed"), dict(total_deletions="0L")), (("changed",), dict(changed_lines="5L")), (("line_refs_unique", "refs_local"), dict(line_refs=_TWICE)), (("refs_local",), dict(cited_refs=_list("z")))]),
    "q32_trace": (dict(status="'failed'", error_code="'X'", sequence="1", started_text="'2026-01-01T00:00:00+00:00'", **_TIMES), [(("times",), _LATE), (("failed_has_code",), dict(status="'success'")), (("failed_has_code",), dict(error_code="cast(null as string)")), (("sequence",), dict(sequence="0")), (("utc",), dict(started_text="'2026-01-01T00:00:00'"))]),
    "q33_report": (dict(review_id="key", decision_review_id="key", trace_id="'t'", decision_trace_id="'t'", status="CASE key % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'FAILED' END", decision_status="CASE key % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'FAILED' END", exit_code="cast(key % 4 as int)", **_TIMES), [(("times",), _LATE), (("review",), dict(decision_review_id="key + 1")), (("trace",), dict(decision_trace_id="'u'")), (("status",), dict(decision_status="'OTHER'")), (("exit_code",), dict(exit_code="cast(key % 4 as int) + 1"))]),
    "q34_policy": (dict(precedence=_list("FAILED", "BLOCK", "NEEDS_REVIEW", "PASS"), rule_ids=_ONE, required_schemas=_ONE, block_levels=_list("E3", "E3"), always_required=_list("detect_secret")), [(("precedence",), dict(precedence=_list("BLOCK", "FAILED", "NEEDS_REVIEW", "PASS"))), (("rule_ids_unique",), dict(rule_ids=_TWICE)), (("required_schemas_unique",), dict(required_schemas=_TWICE)), (("blocks",), dict(block_levels=_list("E3", "E2"))), (("secret_required",), dict(always_required=_list()))]),
    "q35_envelope": (dict(project="'p'", review_id="concat('r', key)", input_ref="concat('shared/projects/p/reviews/r', key, '/input/diff.json')", deadline_text="'2026-01-01T00:00:00Z'"), [(("ref_of_review",), dict(input_ref="'shared/projects/p/reviews/other/input/diff.json'")), (("ref_of_review", "path"), dict(input_ref="'/etc/passwd'")), (("path",), dict(input_ref="concat('shared/projects/p/reviews/r', key, '/input/.hidden')")), (("utc",), dict(deadline_text="'2026-01-01'"))]),
    "q36_assignment": (dict(project="'p'", role="'diff_analyzer'", skill_name="'p-diff-review'", task_id="concat('t', key)", context_ref="concat('shared/tasks/t', key, '/base/role-context.json')", delivery_ref="concat('shared/tasks/t', key, '/workspace/delivery.json')", attempt="1"), [(("skill",), dict(role="'security_scanner'")), (("context",), dict(context_ref="'shared/tasks/x/base/role-context.json'")), (("delivery",), dict(delivery_ref="'shared/tasks/x/workspace/delivery.json'")), (("attempt",), dict(attempt="3")), ((), dict(role="'quality_reviewer'", skill_name="'p-quality-review'"))]),
    "q37_delivery": (dict(input_refs=_ONE, evidence_ids=_ONE, evidence_input_refs=_list("a"), model_calls="1", message="'m'", **_TIMES), [(("input_refs_unique",), dict(input_refs=_TWICE)), (("evidence_ids_unique",), dict(evidence_ids=_TWICE)), (("times",), _LATE), (("evidence_refs",), dict(evidence_input_refs=_list("z"))), (("calls",), dict(model_calls="2")), (("control_bytes",), dict(message="repeat('é', 2049)")), ((), dict(message="repeat('é', 2048)"))]),
    "q38_draft": (dict(change_intents=_ONE, affected_symbols=_list(), line_refs=_ONE, findings="10", confidence="0.0"), [(("change_intents_unique",), dict(change_intents=_TWICE)), (("affected_symbols_unique",), dict(affected_symbols=_TWICE)), (("line_refs_unique",), dict(line_refs=_TWICE)), (("line_limit",), dict(line_refs=_list())), (("line_limit",), dict(line_refs=_list(*"abcdef"))), (("findings_limit",), dict(findings="11")), (("confidence",), dict(confidence="2.0"))]),
    "q39_context_metadata": (dict(changed_files=_list("a.py", "b.py"), unsupported_files=_list(), line_refs=_ONE, evidence_levels=_list("E1"), coverage_skills=_list("detect_injection", "detect_secret", "detect_dangerous_call"), coverage="array(named_struct('status', 'failed', 'error_code', 'X'), named_struct('status', 'completed', 'error_code', cast(null as string)))", source_ids=_list("s"), role="'diff_analyzer'"), [
        (("changed_files_unique",), dict(changed_files=_list("a.py", "a.py"))), (("paths",), dict(changed_files=_list("a.py", "C:/b"))), (("line_refs_unique",), dict(line_refs=_TWICE)), (("evidence_levels_unique",), dict(evidence_levels=_TWICE)), (("coverage_skills_unique", "frozen_coverage"), dict(coverage_skills=_TWICE)), (("coverage_code",), dict(coverage="array(named_struct('status', 'completed', 'error_code', 'X'))")), (("frozen_coverage",), dict(coverage_skills=_list("detect_secret"))), (("sources",), dict(role="'security_scanner'")),
    ]),
    "q40_package": (dict(project="'p'", algorithm="'x'", paths=_list("a/b.py", "c.py"), digests=_list("0", "1"), source_revision="'abc'", runtime_ref="'shared/projects/p/runtime/abc/x.pyz'", tree_sha256=_TREE), [(("paths", "tree"), dict(paths=_list("a/../b.py", "c.py"))), (("sorted", "tree"), dict(paths=_list("c.py", "a/b.py"))), (("paths_unique", "tree"), dict(paths=_list("c.py", "c.py"))), (("tree",), dict(digests=_list("0", "2"))), (("revision_in_ref",), dict(source_revision="'def'")), (("ref",), dict(runtime_ref="'shared/projects/q/runtime/abc/x.pyz'")), (("ref",), dict(runtime_ref="'shared/projects/p/runtime/abc/x.zip'"))]),
    "q02_f06_text": (dict(id="concat('r-', key)", line_ref="concat('L:', key)", sha256="sha2(cast(key as string), 256)", revision="left(sha2(cast(key as string), 256), 40)", at="'2026-01-01T00:00:00Z'"), [(("identifier",), dict(id="'-x1'")), (("identifier",), dict(id="'ab'")), (("line_ref",), dict(line_ref="'a b c'")), (("sha256",), dict(sha256="upper(sha2(cast(key as string), 256))")), (("revision",), dict(revision="'abc'")), (("utc",), dict(at="'2026-01-01T00:00:00+02:00'"))]),
}


def _rows(orders: DataFrame, sound: dict[str, str], faults: list[tuple[tuple[str, ...], dict[str, str]]]) -> DataFrame:
    keyed = orders.select(F.col("o_orderkey").alias("key"))
    fault = F.col("key") % (len(faults) + 1)
    columns = {}
    for name, expression in sound.items():
        value = F.expr(expression)
        for n, (_, changed) in enumerate(faults):
            if name in changed:
                value = F.when(fault == n, F.expr(changed[name])).otherwise(value)
        columns[name] = value
    return keyed.select("key", *[v.alias(c) for c, v in columns.items()])


def _add(name: str, kind: str) -> None:
    sound, faults = FAULTS[name]
    broken = [f"SELECT '{rule}' AS rule, o_orderkey AS key FROM orders WHERE o_orderkey % {len(faults) + 1} = {n}" for n, (rules, _) in enumerate(faults) for rule in rules]
    add(f"{name}_rules", lambda o: constraints.violations(_rows(o, sound, faults), "key", kind), tables=("orders",), sql=" UNION ALL ".join(broken))


for _name in FAULTS:
    _add(_name, _name.split("_", 2 if _name[4:5] == "q" or _name[4:5] == "f" else 1)[-1])
