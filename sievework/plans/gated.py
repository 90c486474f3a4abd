"""Queries over the integrity of records, assurance, the gate and the recheck, with their SQL.

The SQL states each rule on its own, from the relations up; it shares no text with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constraints
from ..operators import agents, assembly, assurance, gate, policy, recheck, validation
from ..operators.gate import RELATIONS, Gate
from ..scratch import cut
from ..sources import sinks
from .registry import add, add_gate, add_sliced, joined

# ---- facts ----------------------------------------------------------------------------------------------------------

_MISPLACED = "coalesce(CASE WHEN x.side = 'old' THEN h.old_path ELSE h.new_path END <> x.file_path, true)"
_ALLOWED = "coalesce((source, detector_name, detector_version) IN (('rule', 'detect_secret', '1.0.0'), ('rule', 'detect_injection', '1.0.0'), ('rule', 'detect_injection', '1.1.0'), ('static_tool', 'detect_injection', '1.0.0'), ('static_tool', 'detect_injection', '1.1.0'), ('rule', 'detect_dangerous_call', '1.0.0'), ('rule', 'detect_dangerous_call', '1.1.0'), ('system', 'policy_integrity', '1.0.0')), false)"
_SPOT = "concat_ws('|', file_path, hunk_id, side, start_line, end_line, snippet_hash)"
_FACTS = f""", alien AS (SELECT DISTINCT review_id, artifact_id FROM artifact WHERE own_review_id <> review_id),
    ev AS (SELECT x.*, right(x.level, 1)::INT AS lv, count(*) OVER (PARTITION BY x.review_id, x.evidence_id) AS copies, x.hunk_id IS NOT NULL AND {_MISPLACED} AS misplaced, x.level = 'E3' AND v.evidence_id IS NULL AS unverified,
        x.level = 'E3' AND NOT {_ALLOWED} AS disallowed, a.artifact_id IS NOT NULL AS alien, x.level <> 'E3' AND v.evidence_id IS NOT NULL AS overstated FROM evidence x LEFT JOIN hunk h ON h.review_id = x.review_id AND h.hunk_id = x.hunk_id
        LEFT JOIN (SELECT DISTINCT review_id, evidence_id FROM verified) v ON v.review_id = x.review_id AND v.evidence_id = x.evidence_id LEFT JOIN alien a ON a.review_id = x.review_id AND a.artifact_id = x.artifact_id),
    proof AS (SELECT *, copies > 1 OR misplaced OR unverified OR disallowed OR alien AS bad FROM ev),
    spot AS (SELECT x.*, {_MISPLACED} AS misplaced FROM place x LEFT JOIN hunk h ON h.review_id = x.review_id AND h.hunk_id = x.hunk_id),
    fit AS (SELECT DISTINCT k.review_id, k.finding_id, k.evidence_id FROM link k JOIN place p USING (review_id, finding_id) JOIN evidence e ON e.review_id = k.review_id AND e.evidence_id = k.evidence_id AND e.file_path = p.file_path AND e.hunk_id = p.hunk_id AND e.side = p.side AND e.start_line <= p.end_line AND p.start_line <= e.end_line),
    pair AS (SELECT DISTINCT k.review_id, k.finding_id, k.evidence_id, e.lv, e.side AS e_side, e.bad, e.evidence_id IS NOT NULL AS known, f.finding_id IS NOT NULL OR n.finding_id IS NULL AS supports FROM link k LEFT JOIN proof e ON e.review_id = k.review_id AND e.evidence_id = k.evidence_id
        LEFT JOIN fit f ON f.review_id = k.review_id AND f.finding_id = k.finding_id AND f.evidence_id = k.evidence_id LEFT JOIN (SELECT DISTINCT review_id, finding_id FROM place) n ON n.review_id = k.review_id AND n.finding_id = k.finding_id),
    good AS (SELECT review_id, finding_id, evidence_id, lv AS level_rank, e_side FROM pair WHERE known AND supports AND NOT bad),
    fact AS (SELECT f.*, CASE f.severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS sev, CASE f.status WHEN 'dismissed' THEN 0 WHEN 'unverified' THEN 1 WHEN 'suspected' THEN 2 ELSE 3 END AS st,
        count(*) OVER (PARTITION BY f.review_id, f.finding_id) AS copies, a.artifact_id IS NOT NULL AS alien, coalesce(s.misplaced, false) AS misplaced, coalesce(s.new_side, false) AS new_side, coalesce(s.places, '') AS places, coalesce(q.dangling, false) AS dangling, coalesce(q.usable, false) AS usable, q.best_new
        FROM finding f LEFT JOIN (SELECT review_id, finding_id, bool_or(misplaced) AS misplaced, bool_or(side = 'new') AS new_side, array_to_string(list_sort(list(DISTINCT {_SPOT})), ';') AS places FROM spot GROUP BY ALL) s ON s.review_id = f.review_id AND s.finding_id = f.finding_id
        LEFT JOIN (SELECT review_id, finding_id, bool_or(NOT known) AS dangling, bool_or(known AND supports AND NOT bad AND lv > 0) AS usable, max(lv) FILTER (known AND supports AND NOT bad AND e_side = 'new') AS best_new FROM pair GROUP BY ALL) q ON q.review_id = f.review_id AND q.finding_id = f.finding_id
        LEFT JOIN alien a ON a.review_id = f.review_id AND a.artifact_id = f.artifact_id),
    judged AS (SELECT *, copies > 1 OR alien OR misplaced OR dangling OR status IN ('confirmed', 'suspected') AND NOT usable AS invalid FROM fact)"""
_COVERAGE = """, cov AS (SELECT c.*, count(*) OVER (PARTITION BY c.review_id, c.coverage_id) AS copies, a.artifact_id IS NOT NULL AS alien, l.coverage_id IS NOT NULL AS no_route, p.coverage_id IS NOT NULL AS no_file, NOT c.mandatory AND (c.skill = 'detect_secret' OR w.coverage_id IS NOT NULL) AS lowered
        FROM coverage c LEFT JOIN alien a ON a.review_id = c.review_id AND a.artifact_id = c.artifact_id
        LEFT JOIN (SELECT DISTINCT k.review_id, k.coverage_id FROM coverage_route k LEFT JOIN route r ON r.review_id = k.review_id AND r.route_id = k.route_id WHERE r.route_id IS NULL) l ON l.review_id = c.review_id AND l.coverage_id = c.coverage_id
        LEFT JOIN (SELECT DISTINCT k.review_id, k.coverage_id, r.skill FROM coverage_route k JOIN route r ON r.review_id = k.review_id AND r.route_id = k.route_id WHERE r.mandatory) w ON w.review_id = c.review_id AND w.coverage_id = c.coverage_id AND w.skill = c.skill
        LEFT JOIN (SELECT DISTINCT f.review_id, f.coverage_id FROM coverage_file f LEFT JOIN (SELECT review_id, old_path AS path FROM hunk UNION SELECT review_id, new_path FROM hunk) h ON h.review_id = f.review_id AND h.path = f.file_path WHERE h.path IS NULL) p ON p.review_id = c.review_id AND p.coverage_id = c.coverage_id),
    sound AS (SELECT * FROM cov WHERE NOT (copies > 1 OR alien OR no_route OR no_file OR lowered)),
    via AS (SELECT DISTINCT s.review_id, s.coverage_id, s.skill, s.mandatory, s.status, s.error_code, k.route_id FROM sound s JOIN coverage_route k ON k.review_id = s.review_id AND k.coverage_id = s.coverage_id),
    gap AS (SELECT review_id, coverage_id, error_code FROM sound WHERE mandatory AND status <> 'completed'
        UNION SELECT r.review_id, c.coverage_id, c.error_code FROM (SELECT r.review_id FROM review r LEFT JOIN sound c ON c.review_id = r.review_id AND c.skill = 'detect_secret' GROUP BY ALL HAVING NOT coalesce(bool_and(c.mandatory AND c.status = 'completed'), false)) r LEFT JOIN sound c ON c.review_id = r.review_id AND c.skill = 'detect_secret'
        UNION SELECT r.review_id, c.coverage_id, c.error_code FROM (SELECT r.review_id, r.route_id, r.skill FROM route r LEFT JOIN via c ON c.review_id = r.review_id AND c.route_id = r.route_id AND c.skill = r.skill WHERE r.mandatory GROUP BY ALL HAVING NOT coalesce(bool_and(c.mandatory AND c.status = 'completed'), false)) r LEFT JOIN via c ON c.review_id = r.review_id AND c.route_id = r.route_id AND c.skill = r.skill)"""
_ABOVE = ", above AS (WITH RECURSIVE up AS (SELECT review_id, artifact_id, parent_id FROM lineage UNION SELECT u.review_id, u.artifact_id, l.parent_id FROM up u JOIN lineage l ON l.review_id = u.review_id AND l.artifact_id = u.parent_id) SELECT * FROM up)"
_ISSUES = _FACTS + _COVERAGE + _ABOVE + f""", issue AS (SELECT DISTINCT * FROM (
    SELECT review_id, 'DUPLICATE_EVIDENCE_ID' AS code, evidence_id AS subject FROM ev WHERE copies > 1 UNION ALL SELECT review_id, 'EVIDENCE_LOCATION_INVALID', evidence_id FROM ev WHERE misplaced UNION ALL SELECT review_id, 'E3_PROVENANCE_UNVERIFIED', evidence_id FROM ev WHERE unverified
    UNION ALL SELECT review_id, 'E3_DETECTOR_NOT_ALLOWED', evidence_id FROM ev WHERE disallowed UNION ALL SELECT review_id, 'VERIFIED_E3_NOT_E3', evidence_id FROM ev WHERE overstated
    UNION ALL SELECT review_id, 'VERIFIED_E3_DANGLING', evidence_id FROM verified v WHERE NOT EXISTS (FROM evidence e WHERE e.review_id = v.review_id AND e.evidence_id = v.evidence_id)
    UNION ALL SELECT review_id, 'DUPLICATE_FINDING_ID', finding_id FROM fact WHERE copies > 1 UNION ALL SELECT review_id, 'FINDING_LOCATION_INVALID', finding_id FROM fact WHERE misplaced UNION ALL SELECT review_id, 'FINDING_EVIDENCE_DANGLING', finding_id FROM fact WHERE dangling
    UNION ALL SELECT review_id, 'FINDING_HAS_NO_QUALIFIED_EVIDENCE', finding_id FROM fact WHERE status IN ('confirmed', 'suspected') AND NOT usable
    UNION ALL SELECT review_id, 'EVIDENCE_FINDING_LOCATION_MISMATCH', finding_id || ':' || evidence_id FROM pair WHERE known AND NOT supports AND (review_id, finding_id) IN (SELECT review_id, finding_id FROM finding)
    UNION ALL SELECT review_id, 'DUPLICATE_COVERAGE_ID', coverage_id FROM cov WHERE copies > 1 UNION ALL SELECT review_id, 'COVERAGE_ROUTE_DANGLING', coverage_id FROM cov WHERE no_route UNION ALL SELECT review_id, 'COVERAGE_FILE_INVALID', coverage_id FROM cov WHERE no_file UNION ALL SELECT review_id, 'MANDATORY_COVERAGE_DOWNGRADED', coverage_id FROM cov WHERE lowered
    UNION ALL SELECT review_id, 'PLANNED_COVERAGE_MISSING', route_id || ':' || skill FROM route r WHERE NOT EXISTS (FROM coverage c JOIN coverage_route k ON k.review_id = c.review_id AND k.coverage_id = c.coverage_id WHERE c.review_id = r.review_id AND k.route_id = r.route_id AND c.skill = r.skill)
    UNION ALL SELECT r.review_id, 'PLANNED_COVERAGE_MISSING', s.skill FROM review r CROSS JOIN (VALUES ('detect_secret'), ('security_semantic_review'), ('review_code_quality')) s(skill) WHERE NOT EXISTS (FROM coverage c WHERE c.review_id = r.review_id AND c.skill = s.skill)
    UNION ALL SELECT x.review_id, 'ROUTE_LOCATION_INVALID', route_id FROM route_place x LEFT JOIN hunk h ON h.review_id = x.review_id AND h.hunk_id = x.hunk_id WHERE {_MISPLACED}
    UNION ALL SELECT review_id, 'DUPLICATE_ARTIFACT_ID', artifact_id FROM artifact GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT review_id, 'ARTIFACT_REVIEW_MISMATCH', artifact_id FROM alien
    UNION ALL SELECT review_id, 'ARTIFACT_LINEAGE_DANGLING', artifact_id FROM lineage l WHERE NOT EXISTS (FROM artifact a WHERE a.review_id = l.review_id AND a.artifact_id = l.parent_id) AND NOT EXISTS (FROM root t WHERE t.review_id = l.review_id AND t.root_id = l.parent_id)
    UNION ALL SELECT review_id, 'ARTIFACT_LINEAGE_CYCLE', artifact_id FROM above WHERE artifact_id = parent_id
    UNION ALL SELECT review_id, 'DUPLICATE_CONFLICT_ID', conflict_id FROM conflict GROUP BY ALL HAVING count(DISTINCT entry) > 1 UNION ALL SELECT review_id, 'CONFLICT_RULE_DANGLING', conflict_id FROM conflict WHERE rule_id NOT IN ('P001', 'F001', 'F002', 'F003', 'B001', 'B002', 'B003', 'B004', 'N001', 'N002', 'N003', 'N004', 'N005', 'N006', 'N007', 'N008')
    UNION ALL SELECT review_id, 'CONFLICT_FINDING_DANGLING', conflict_id FROM conflict c WHERE NOT EXISTS (FROM finding f WHERE f.review_id = c.review_id AND f.finding_id = c.finding_id)))"""
_RELATED = ", related AS (SELECT DISTINCT f.review_id, r.route_id, f.finding_id FROM finding f JOIN place p USING (review_id, finding_id) JOIN route r ON r.review_id = f.review_id AND r.category = f.category JOIN route_place q ON q.review_id = r.review_id AND q.route_id = r.route_id AND q.file_path = p.file_path AND q.hunk_id = p.hunk_id AND q.side = p.side AND p.start_line <= q.end_line AND q.start_line <= p.end_line)"
_LACKING = ", lacking AS (SELECT r.review_id, r.route_id, r.skill FROM (SELECT DISTINCT review_id, route_id, skill FROM route) r LEFT JOIN (SELECT c.review_id, c.skill, c.status, k.route_id FROM coverage c JOIN (SELECT DISTINCT review_id, coverage_id, route_id FROM coverage_route) k ON k.review_id = c.review_id AND k.coverage_id = c.coverage_id) c ON c.review_id = r.review_id AND c.route_id = r.route_id AND c.skill = r.skill GROUP BY ALL HAVING NOT coalesce(bool_and(c.status = 'completed'), false))"
_CONFLICTS = _ISSUES + _RELATED + _LACKING + """, alike AS (SELECT review_id, category, places, list_sort(list(DISTINCT finding_id)) AS ids, bool_or(status = 'dismissed') AS no, bool_or(status IN ('confirmed', 'suspected')) AS yes, max(sev) - min(sev) AS spread FROM judged GROUP BY ALL HAVING count(*) > 1),
    found AS (SELECT review_id, 'contradiction' AS type, ids AS finding_ids, false AS resolved FROM alike WHERE no AND yes UNION ALL SELECT review_id, 'severity_mismatch', ids, false FROM alike WHERE spread >= 2
        UNION ALL SELECT review_id, 'location_mismatch', list_sort(list(DISTINCT finding_id)), false FROM judged GROUP BY review_id, fingerprint HAVING count(*) > 1 AND count(DISTINCT (category, places)) > 1
        UNION ALL SELECT l.review_id, 'coverage_gap', list_sort(list(DISTINCT finding_id)), false FROM lacking l JOIN related r ON r.review_id = l.review_id AND r.route_id = l.route_id GROUP BY l.review_id, l.route_id, l.skill
        UNION ALL SELECT review_id, min(type), list_sort(list(DISTINCT finding_id)), bool_and(resolved) FROM conflict GROUP BY review_id, conflict_id)"""
_GATE = _CONFLICTS + """, contested AS (SELECT DISTINCT review_id, unnest(finding_ids) AS finding_id FROM found WHERE NOT resolved),
    barred AS (SELECT DISTINCT review_id, unnest(finding_ids) AS finding_id FROM found WHERE NOT resolved AND type <> 'coverage_gap'),
    tampered AS (SELECT DISTINCT review_id FROM issue WHERE code NOT IN ('VERIFIED_E3_NOT_E3', 'E3_DETECTOR_NOT_ALLOWED', 'FINDING_HAS_NO_QUALIFIED_EVIDENCE', 'COVERAGE_ROUTE_DANGLING', 'COVERAGE_FILE_INVALID', 'PLANNED_COVERAGE_MISSING', 'MANDATORY_COVERAGE_DOWNGRADED', 'ARTIFACT_REVIEW_MISMATCH')),
    strong AS (SELECT j.*, NOT invalid AND new_side AND status = 'confirmed' AND sev >= 3 AND coalesce(best_new, 0) >= 3 AND NOT EXISTS (FROM barred b WHERE b.review_id = j.review_id AND b.finding_id = j.finding_id) AS strong FROM judged j),
    block AS (SELECT review_id, finding_id, CASE WHEN category = 'secret' THEN 'B001' WHEN category = 'sql_injection' THEN 'B003' ELSE 'B002' END AS rule_id FROM strong WHERE strong AND category IN ('secret', 'sql_injection', 'command_injection', 'dangerous_call')
        UNION SELECT review_id, finding_id, 'B004' FROM strong WHERE strong AND review_id IN (SELECT review_id FROM tampered)),
    weighed AS (SELECT s.*, EXISTS (FROM block b WHERE b.review_id = s.review_id AND b.finding_id = s.finding_id) AS blocking, EXISTS (FROM contested c WHERE c.review_id = s.review_id AND c.finding_id = s.finding_id) AS contested FROM strong s),
    bucket AS (SELECT DISTINCT review_id, finding_id, CASE WHEN blocking THEN 'blocking' WHEN status <> 'dismissed' AND sev >= 2 OR invalid OR contested THEN 'review' WHEN status <> 'dismissed' THEN 'warning' END AS bucket FROM weighed),
    lack AS (SELECT r.review_id, s.schema_name, count(a.artifact_id) AS n FROM review r CROSS JOIN (VALUES ('SecurityReview', 'security-scanner', 'Security Scanner'), ('QualityReview', 'quality-reviewer', 'Quality Reviewer')) s(schema_name, agent, role) LEFT JOIN artifact a ON a.review_id = r.review_id AND a.schema_name = s.schema_name
        GROUP BY r.review_id, s.schema_name HAVING count(a.artifact_id) <> 1 OR NOT bool_or(coalesce(a.schema_version = '1.0.0' AND a.agent_id = s.agent AND a.agent_role = s.role AND a.status = 'success' AND a.own_review_id = a.review_id, false))),
    hit AS (SELECT review_id, rule_id FROM block UNION SELECT review_id, 'N001' FROM gap UNION SELECT review_id, 'N002' FROM review WHERE truncated OR unsupported UNION SELECT review_id, 'N003' FROM found WHERE NOT resolved
        UNION SELECT review_id, 'N004' FROM weighed WHERE status <> 'dismissed' AND sev >= 3 AND NOT blocking UNION SELECT review_id, 'N005' FROM weighed WHERE status <> 'dismissed' AND sev = 2 AND NOT blocking UNION SELECT review_id, 'N006' FROM issue UNION SELECT review_id, 'N006' FROM lack UNION SELECT review_id, 'N006' FROM review WHERE repair_exhausted
        UNION SELECT review_id, 'N007' FROM gap WHERE error_code IN ('MODEL_AUTH_ERROR', 'MODEL_ERROR', 'MODEL_QUOTA_EXCEEDED', 'RATE_LIMITED', 'TIMEOUT') UNION SELECT review_id, 'N008' FROM review WHERE recheck_exhausted),
    known_hit AS (SELECT * FROM hit WHERE review_id IN (SELECT review_id FROM review)),
    decision AS (SELECT r.review_id, trim(r.trace_id) = '' OR r.decided_at IS NULL OR r.risk_review_id <> r.review_id AS broken, list_sort(list(h.rule_id) FILTER (h.rule_id IS NOT NULL)) AS ids FROM review r LEFT JOIN known_hit h ON h.review_id = r.review_id GROUP BY ALL),
    verdict AS (SELECT review_id, CASE WHEN broken THEN 'FAILED' WHEN ids IS NULL OR len(ids) = 0 THEN 'PASS' WHEN ids[1] LIKE 'B%' THEN 'BLOCK' ELSE 'NEEDS_REVIEW' END AS status, CASE WHEN broken THEN ['F001'] WHEN ids IS NULL OR len(ids) = 0 THEN ['P001'] ELSE ids END AS ids FROM decision)"""


def _coded(*codes: str) -> Callable[[Gate], DataFrame]:
    return lambda g: g.issues_of(*codes)


def _from(*codes: str) -> str:
    return _ISSUES + f" SELECT * FROM issue WHERE code IN ({', '.join(repr(c) for c in codes)})"


# ---- integrity ------------------------------------------------------------------------------------------------------

_PROOF = ("evidence", "verified", "hunk", "artifact")
_COVER = ("coverage", "coverage_route", "coverage_file", "route", "hunk", "artifact")
_KNOWN = (*_PROOF, "finding", "place", "link")
#: Relations that the issues of a query are read off, by the start of its name.
_NEEDS = {"d01": ("finding", "link", "evidence"), "d02": ("finding", "place", "link", "evidence"), "d05": ("finding", "place", "evidence", "route_place", "hunk"), "d06": ("evidence", "verified"), "d07": ("evidence", "verified"), "d08": ("evidence",), "d09": ("coverage", "coverage_route", "coverage_file", "route", "hunk"), "d11": ("review", *_COVER), "d12": ("lineage", "artifact", "root"), "d13": ("conflict", "finding"), "p06": _KNOWN, "p07": ("artifact",), "p08": ("lineage",)}

for _name, _codes in {
    "d01_dangling": ["FINDING_EVIDENCE_DANGLING"], "d02_interval_support": ["EVIDENCE_FINDING_LOCATION_MISMATCH"], "d05_c07_location": ["FINDING_LOCATION_INVALID", "EVIDENCE_LOCATION_INVALID", "ROUTE_LOCATION_INVALID"], "d06_unverified_e3": ["E3_PROVENANCE_UNVERIFIED"],
    "d07_verified": ["VERIFIED_E3_DANGLING", "VERIFIED_E3_NOT_E3"], "d08_allowlist": ["E3_DETECTOR_NOT_ALLOWED"], "d09_d10_coverage_refs": ["COVERAGE_ROUTE_DANGLING", "COVERAGE_FILE_INVALID"], "d11_planned_missing": ["PLANNED_COVERAGE_MISSING", "MANDATORY_COVERAGE_DOWNGRADED"],
    "d12_lineage_dangling": ["ARTIFACT_LINEAGE_DANGLING"], "d13_conflict_refs": ["CONFLICT_FINDING_DANGLING", "CONFLICT_RULE_DANGLING"], "e09_duplicates": ["DUPLICATE_ARTIFACT_ID", "DUPLICATE_FINDING_ID", "DUPLICATE_EVIDENCE_ID", "DUPLICATE_COVERAGE_ID", "DUPLICATE_CONFLICT_ID"],
    "p06_no_evidence": ["FINDING_HAS_NO_QUALIFIED_EVIDENCE"], "p07_review_mismatch": ["ARTIFACT_REVIEW_MISMATCH"], "p08_cycles": ["ARTIFACT_LINEAGE_CYCLE"],
}.items():
    add_gate(_name, _coded(*_codes), _from(*_codes), _NEEDS.get(_name[:3], RELATIONS))
add_gate("e10_all_issues", lambda g: g.issues, _ISSUES + " SELECT * FROM issue")
add_gate("u02_valid_records", lambda g: g.finding.where("not invalid").select("review_id", F.lit("finding").alias("kind"), F.col("finding_id").alias("id")).unionByName(g.evidence.where("here and not bad").select("review_id", F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"))).unionByName(g.coverage.where("not bad").select("review_id", F.lit("coverage").alias("kind"), F.col("coverage_id").alias("id"))), _ISSUES + " SELECT review_id, 'finding' AS kind, finding_id AS id FROM judged WHERE NOT invalid UNION ALL SELECT review_id, 'evidence', evidence_id FROM proof WHERE NOT bad UNION ALL SELECT review_id, 'coverage', coverage_id FROM sound")
add_gate("d20_required_artifacts", lambda g: gate.incomplete_artifacts(g.r["review"], g.r["artifact"]), _GATE + " SELECT * FROM lack", needs=("review", "artifact"))
add_gate("b14_flattened", lambda g: assembly.flattened(finding=g.r["finding"], evidence=g.r["evidence"], coverage=g.r["coverage"]), " SELECT review_id, artifact_id, 'finding' AS kind, finding_id AS id FROM finding UNION ALL SELECT review_id, artifact_id, 'evidence', evidence_id FROM evidence UNION ALL SELECT review_id, artifact_id, 'coverage', coverage_id FROM coverage", needs=())
add_gate("c05_verified_projection", lambda g: assembly.verified_e3(g.r["evidence"]), " SELECT DISTINCT review_id, evidence_id FROM evidence WHERE level = 'E3' AND source IN ('rule', 'static_tool')", needs=("evidence",))

# ---- assurance ------------------------------------------------------------------------------------------------------

add_gate("d03_route_overlap", lambda g: g.related, _RELATED + " SELECT * FROM related", needs=("finding", "place", "route", "route_place"))
add_gate("e02_e03_canonical_findings", lambda g: g.canonical_findings().select("review_id", "selected", joined("members")), _FACTS + " SELECT review_id, arg_max(finding_id, (NOT invalid, st, sev, confidence_pct, finding_id)) AS selected, array_to_string(list_sort(list(DISTINCT finding_id)), ',') AS members FROM judged GROUP BY review_id, category, places", needs=_KNOWN)
add_gate("e04_canonical_evidence", lambda g: g.canonical_evidence().select("review_id", "selected", joined("members")), _FACTS + f" SELECT review_id, arg_min(evidence_id, (bad, -lv, evidence_id)) AS selected, array_to_string(list_sort(list(DISTINCT evidence_id)), ',') AS members FROM proof GROUP BY review_id, content_hash, file_path IS NULL, {_SPOT}", needs=_PROOF)
_CITED = ("finding", "place", "route", "route_place", "coverage", "coverage_route", "conflict")
add_gate("e05_e07_conflicts", lambda g: g.conflicts.select("review_id", "type", joined("finding_ids"), "resolved"), _CONFLICTS + " SELECT review_id, type, array_to_string(finding_ids, ',') AS finding_ids, resolved FROM found", needs=_CITED)
add_gate("u01_merged_conflicts", lambda g: _merged(g), _CONFLICTS + " SELECT review_id, type, array_to_string(finding_ids, ',') AS finding_ids, array_to_string(finding_ids, ',') LIKE '%7%' AS supplied FROM found WHERE type IN ('severity_mismatch', 'location_mismatch')", needs=("finding", "place"))
add_gate("e08_coverage_gaps", lambda g: g.coverage_gaps.select("review_id", "route_id", "skill", joined("finding_ids")), _RELATED + _LACKING + " SELECT l.review_id, l.route_id, l.skill, coalesce(array_to_string(list_sort(list(DISTINCT finding_id) FILTER (finding_id IS NOT NULL)), ','), '') AS finding_ids FROM lacking l LEFT JOIN related r ON r.review_id = l.review_id AND r.route_id = l.route_id GROUP BY l.review_id, l.route_id, l.skill", needs=("finding", "place", "route", "route_place", "coverage", "coverage_route"))
_ASSURED = """, last AS (SELECT c.* FROM conflict c JOIN (SELECT review_id, conflict_id, max(entry) AS entry FROM conflict GROUP BY ALL) USING (review_id, conflict_id, entry)),
    assured AS (SELECT * FROM issue WHERE code NOT IN ('DUPLICATE_CONFLICT_ID', 'CONFLICT_FINDING_DANGLING', 'CONFLICT_RULE_DANGLING') UNION SELECT review_id, 'CONFLICT_FINDING_DANGLING', conflict_id FROM last c WHERE NOT EXISTS (FROM finding f WHERE f.review_id = c.review_id AND f.finding_id = c.finding_id)
        UNION SELECT review_id, 'CONFLICT_RULE_DANGLING', conflict_id FROM last WHERE rule_id = 'N999')"""
add_gate("v01_assured_issues", lambda g: g.assured_conflict_issues, _CONFLICTS + _ASSURED + " SELECT * FROM assured WHERE code LIKE '%CONFLICT%'", needs=("conflict", "finding"))
add_gate("v01_report", lambda g: assurance.report(g.finding, g.evidence, g.assured_issues, g.conflicts), _CONFLICTS + _ASSURED + f""" SELECT review_id, count(DISTINCT finding_id) AS findings, count(DISTINCT finding_id) FILTER (NOT invalid) AS valid_findings, count(DISTINCT (category, places)) AS canonical_findings, coalesce(any_value(e.n), 0) AS evidence, coalesce(any_value(e.ok), 0) AS valid_evidence, coalesce(any_value(e.canonical), 0) AS canonical_evidence, coalesce(any_value(i.n), 0) AS issues, coalesce(any_value(c.n), 0) AS conflicts
    FROM judged LEFT JOIN (SELECT review_id, count(DISTINCT evidence_id) AS n, count(DISTINCT evidence_id) FILTER (NOT bad) AS ok, count(DISTINCT (content_hash, file_path IS NULL, {_SPOT})) AS canonical FROM proof GROUP BY review_id) e USING (review_id) LEFT JOIN (SELECT review_id, count(*) AS n FROM assured GROUP BY review_id) i USING (review_id) LEFT JOIN (SELECT review_id, count(*) AS n FROM found GROUP BY review_id) c USING (review_id) GROUP BY review_id""")


def _merged(g: Gate) -> DataFrame:
    found = assurance.detected_conflicts(g.identified(), g.coverage_gaps).where("type <> 'coverage_gap' and type <> 'contradiction'").withColumn("supplied", F.lit(False))
    given = found.where("array_join(finding_ids, ',') LIKE '%7%'").withColumn("supplied", F.lit(True))
    return assurance.merged_conflicts(found, given).select("review_id", "type", joined("finding_ids"), "supplied")


# ---- the gate -------------------------------------------------------------------------------------------------------

add_gate("c08_qualified_evidence", lambda g: g.pairs.where("good").select("review_id", "finding_id", "evidence_id", "level_rank"), _FACTS + " SELECT review_id, finding_id, evidence_id, level_rank FROM good", needs=_KNOWN)
add_gate("e13_evidence_index", lambda g: g.finding.where("size(evidence_ids) > 0").select("review_id", "finding_id", joined("evidence_ids")).distinct(), _FACTS + " SELECT review_id, finding_id, array_to_string(list_sort(list(DISTINCT evidence_id)), ',') AS evidence_ids FROM good WHERE (review_id, finding_id) IN (SELECT review_id, finding_id FROM finding) GROUP BY ALL", needs=_KNOWN)
add_gate("c09_e12_block", lambda g: g.marked.select("review_id", F.explode("blocks").alias("rule_id"), "finding_id").distinct(), _GATE + " SELECT review_id, rule_id, finding_id FROM block WHERE rule_id <> 'B004'", needs=(*_KNOWN, "route", "route_place", "coverage", "coverage_route", "conflict"))
add_gate("p03_b004", lambda g: _named(g if "buckets" in g.__dict__ else g.of_reviews(g.strong_reviews()), policy.INTEGRITY_BLOCK), _GATE + " SELECT review_id, rule_id, finding_id FROM block WHERE rule_id = 'B004'", needs=("finding", "link", "evidence", "verified"))
add_gate("c10_buckets", lambda g: g.buckets.select("review_id", "finding_id", "bucket"), _GATE + " SELECT * FROM bucket WHERE bucket IS NOT NULL")
add_gate("d22_e14_mandatory", lambda g: g.gaps.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_set("coverage_id")), ",").alias("failing"), F.bool_or("provider_failure").alias("provider_failure")), _ISSUES + " SELECT review_id, coalesce(array_to_string(list_sort(list(DISTINCT coverage_id) FILTER (coverage_id IS NOT NULL)), ','), '') AS failing, bool_or(coalesce(error_code IN ('MODEL_AUTH_ERROR', 'MODEL_ERROR', 'MODEL_QUOTA_EXCEEDED', 'RATE_LIMITED', 'TIMEOUT'), false)) AS provider_failure FROM gap GROUP BY review_id", needs=("review", *_COVER))
add_gate("p04_n_rules", lambda g: g.rules.select("review_id", F.explode("rules").alias("rule_id")), _GATE + " SELECT * FROM known_hit")
add_gate("p05_disqualified", lambda g: assurance.disqualified(g.conflicts), _GATE + " SELECT * FROM barred")
add_gate("p09_failures", lambda g: g.failures, " SELECT review_id, 'F001' AS failure FROM review WHERE review_id % 83 = 7 OR review_id % 89 = 3 OR review_id % 97 = 11", needs=())
add_gate("p09_no_policy", lambda g: gate.safe_gate(None, **g.r).select("review_id", "status", joined("rule_ids"), "reason"), " SELECT review_id, 'FAILED' AS status, 'F002' AS rule_ids, 'FAILED: the requested policy is unavailable or invalid.' AS reason FROM review", needs=())
add_gate("p01_w11_decision", lambda g: g.decisions.select("review_id", "status", joined("rule_ids"), "exit_code"), _GATE + " SELECT review_id, status, array_to_string(ids, ',') AS rule_ids, CASE status WHEN 'PASS' THEN 0 WHEN 'BLOCK' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 3 END AS exit_code FROM verdict")
_N = "array_to_string([x for x in ids if x LIKE 'N%'], ', ')"
add_gate("p11_reason", lambda g: g.decisions.select("review_id", "reason", F.size("actions").alias("actions")), _GATE + f""" SELECT review_id, CASE status WHEN 'FAILED' THEN 'FAILED: the core review context is invalid.' WHEN 'PASS' THEN 'PASS: all mvp-1.0.0 mandatory checks completed with no blocking evidence.' WHEN 'BLOCK' THEN 'BLOCK: deterministic strong evidence matched ' || array_to_string([x for x in ids if x LIKE 'B%'], ', ') || CASE WHEN {_N} <> '' THEN '; review remains incomplete under ' || {_N} ELSE '' END || '.'
    ELSE 'NEEDS_REVIEW: fail-closed review conditions matched ' || {_N} || '.' END AS reason, len([x for x in ids if x LIKE 'N%'])::INT AS actions FROM verdict""")
add_gate("p10_coherence", lambda g: constraints.violations(_bent(g.decisions), "review_id", "decision"), _GATE + " SELECT 'pass_only_p001' AS rule, review_id AS key FROM verdict WHERE status <> 'PASS' AND status <> 'FAILED' AND review_id % 13 = 0 UNION ALL SELECT 'block_has_b', review_id FROM verdict WHERE status = 'NEEDS_REVIEW' AND review_id % 13 = 1 UNION ALL SELECT 'failed_has_f', review_id FROM verdict WHERE status <> 'FAILED' AND review_id % 13 = 2")
add_gate("u04_disjoint_buckets", lambda g: assembly.overlapping_buckets(g.buckets.unionByName(g.buckets.where("bucket = 'warning'").withColumn("bucket", F.lit("review")))), _GATE + " SELECT review_id, finding_id, 2::BIGINT AS n FROM bucket WHERE bucket = 'warning'")
add_gate("a20_markdown", lambda g: sinks.markdown_report(g.decisions, g.r["finding"].distinct()).select("review_id", F.sha2("report", 256).alias("digest")), _GATE + r""" SELECT d.review_id, sha256('# Review ' || d.review_id || chr(10) || chr(10) || 'Status: ' || d.status || chr(10) || chr(10) || '| finding | severity | status | category |' || chr(10) || '|---|---|---|---|' || chr(10) || coalesce(string_agg('| ' || finding_id || ' | ' || severity || ' | ' || f.status || ' | ' || category || ' |', chr(10) ORDER BY finding_id), '')) AS digest FROM verdict d LEFT JOIN (SELECT DISTINCT * FROM finding) f USING (review_id) GROUP BY d.review_id, d.status""")


def _named(g: Gate, *rules: str) -> DataFrame:
    rows = g.buckets.select("review_id", F.explode("rules").alias("rule_id"), "finding_id")
    return rows.where(F.col("rule_id").isin(*rules)).distinct()


def _bent(decision: DataFrame) -> DataFrame:
    """Decisions of which some claim another status than their rules allow."""
    n, failed = F.col("review_id") % 13, F.col("status") == "FAILED"
    status = F.when((n == 0) & ~failed, "PASS").when((n == 1) & (F.col("status") == "NEEDS_REVIEW"), "BLOCK").when(n == 2, "FAILED").otherwise(F.col("status"))
    return decision.withColumn("status", status)


# ---- recheck --------------------------------------------------------------------------------------------------------

_TARGETS = _GATE + """, undecided AS (SELECT review_id FROM verdict WHERE status = 'NEEDS_REVIEW'),
    asked AS (SELECT review_id, 'conflict' AS kind, type || array_to_string(finding_ids, ',') AS subject FROM found WHERE NOT resolved
        UNION ALL SELECT DISTINCT w.review_id, 'finding', w.finding_id FROM (SELECT review_id, finding_id FROM bucket WHERE bucket = 'review' UNION SELECT review_id, finding_id FROM judged WHERE invalid) w JOIN place p ON p.review_id = w.review_id AND p.finding_id = w.finding_id WHERE (w.review_id, w.finding_id) NOT IN (SELECT review_id, finding_id FROM contested)
        UNION ALL SELECT r.review_id, 'coverage', r.skill FROM (SELECT review_id, skill FROM review CROSS JOIN (VALUES ('detect_secret'), ('security_semantic_review'), ('review_code_quality')) s(skill)) r LEFT JOIN sound c ON c.review_id = r.review_id AND c.skill = r.skill GROUP BY r.review_id, r.skill HAVING NOT coalesce(bool_and(c.mandatory AND c.status = 'completed'), false)
        UNION ALL SELECT r.review_id, 'coverage', r.skill || ':' || r.route_id FROM route r LEFT JOIN via c ON c.review_id = r.review_id AND c.route_id = r.route_id AND c.skill = r.skill WHERE r.mandatory GROUP BY r.review_id, r.skill, r.route_id HAVING NOT coalesce(bool_and(c.mandatory AND c.status = 'completed'), false)),
    target AS (SELECT * FROM asked WHERE review_id IN (SELECT review_id FROM undecided))"""
add_gate("k01_targets", lambda g: recheck.targets(g).select("review_id", "kind", F.when(F.col("kind") != "conflict", F.col("subject")).otherwise("").alias("subject")), _TARGETS + " SELECT review_id, kind, CASE WHEN kind <> 'conflict' THEN subject ELSE '' END AS subject FROM target")
add_gate("k01_requests", lambda g: recheck.requests(recheck.targets(g, located=False)).select("review_id", "targets"), _TARGETS + " SELECT review_id, count(*)::INT AS targets FROM target GROUP BY review_id")
add_gate("w12_oversized", lambda g: recheck.oversized(recheck.targets(g, located=False), 5), _TARGETS + " SELECT review_id, count(*) AS targets FROM target GROUP BY review_id HAVING count(*) > 5")


def _second(f: DataFrame, e: DataFrame, p: DataFrame) -> dict[str, DataFrame]:
    """The relations of a recheck: every finding is a target at its places; results hold one fault of every kind here and there."""
    n, m = F.col("review_id") % 60, F.col("review_id")
    finding, evidence = cut(f.dropDuplicates(["review_id", "finding_id"]).select("review_id", "finding_id", "artifact_id", "status", "end_line"), "finding"), e.dropDuplicates(["review_id", "evidence_id"])
    reviews = finding.select("review_id").distinct()
    spots = p.groupBy("review_id", "finding_id").agg(F.array_sort(F.collect_list(F.struct(*validation.SPOT))).alias("places"))
    target = finding.where("end_line % 2 = 0").select("review_id", "finding_id").join(spots, ["review_id", "finding_id"]).select("review_id", F.concat(F.lit("t-"), "finding_id").alias("target_id"), F.array("finding_id").alias("finding_ids"), F.concat(F.lit("x-"), "finding_id").alias("conflict_id"), F.lit("detect_secret").alias("skill"), F.lit("r-1").alias("route_id"), "places")
    target = cut(target, "target")
    request = reviews.select("review_id", F.concat(F.lit("q-"), m.cast("string")).alias("request_id"))
    result = reviews.select("review_id", F.when(n == 1, "q-other").otherwise(F.concat(F.lit("q-"), m.cast("string"))).alias("given_request_id"), F.when(n == 2, m + 1).otherwise(m).alias("given_review_id"), F.when(n == 3, 2).otherwise(1).alias("attempt"), F.when(n == 4, "failed").otherwise("success").alias("status"))
    base = e.where("evidence_id like 'e-%'").dropDuplicates(["review_id", "evidence_id"]).join(target.select("review_id", F.col("finding_ids")[0].alias("finding_id")), ["review_id", "finding_id"]).withColumn("evidence_id", F.when(n == 5, F.col("evidence_id")).otherwise(F.concat(F.lit("new-"), "evidence_id")))
    base = cut(base, "base")
    added = base.unionByName(base.where(n == 6))
    registry = added.where("level = 'E3'").where(n != 7).select("review_id", "evidence_id").unionByName(added.where(n == 8).select("review_id", F.concat(F.lit("no-"), "evidence_id").alias("evidence_id"))).distinct()
    linked = base.where(n != 9).select("review_id", "finding_id", "evidence_id")
    linked = linked.unionByName(base.where(n == 10).select("review_id", "finding_id", "evidence_id")).unionByName(base.where(n == 11).select("review_id", F.lit("f-outside").alias("finding_id"), "evidence_id"))
    resolution = base.where(n >= 12).select("review_id", "finding_id", F.lit("confirmed").alias("status")).distinct()
    resolution = resolution.unionByName(reviews.where(n == 12).select("review_id", F.lit("f-outside").alias("finding_id"), F.lit("unverified").alias("status")))
    conflict = target.select("review_id", F.when(n == 13, "x-outside").otherwise(F.col("conflict_id")).alias("conflict_id")).distinct()
    update = target.select("review_id", F.when(n == 14, "review_code_quality").otherwise("detect_secret").alias("skill"), F.when(n == 15, "r-2").otherwise("r-1").alias("route_id"), (n != 16).alias("mandatory")).distinct()
    return dict(request=request, target=target, original=evidence, finding=finding, result=result, added=added, added_link=linked, added_verified=registry, finding_resolution=resolution, conflict_resolution=conflict, coverage_update=update)


_SECOND = """, f1 AS (SELECT DISTINCT ON (review_id, finding_id) * FROM finding), e1 AS (SELECT DISTINCT ON (review_id, evidence_id) * FROM evidence), t AS (SELECT DISTINCT f1.review_id, f1.finding_id FROM f1 JOIN place USING (review_id, finding_id) WHERE f1.end_line % 2 = 0),
    base AS (SELECT e1.*, e1.review_id % 60 AS n FROM e1 JOIN t USING (review_id, finding_id) WHERE evidence_id LIKE 'e-%'), r AS (SELECT DISTINCT review_id, review_id % 60 AS n FROM f1),
    proven AS (SELECT review_id, finding_id FROM base WHERE n <> 9 AND source <> 'llm' AND level IN ('E2', 'E3') AND hunk_id IS NOT NULL),
    broken AS (SELECT review_id, 'REQUEST_MISMATCH' AS rule FROM r WHERE n = 1 UNION SELECT review_id, 'REVIEW_MISMATCH' FROM r WHERE n = 2 UNION SELECT review_id, 'ATTEMPT_MISMATCH' FROM r WHERE n = 3 UNION SELECT review_id, 'NOT_SUCCESSFUL' FROM r WHERE n = 4 UNION SELECT review_id, 'EVIDENCE_NOT_NEW' FROM base WHERE n = 5 UNION SELECT review_id, 'EVIDENCE_REPEATED' FROM base WHERE n = 6
        UNION SELECT review_id, 'E3_UNREGISTERED' FROM base WHERE n = 7 AND level = 'E3' UNION SELECT review_id, unnest(['REGISTRY_OUT_OF_SCOPE', 'E3_UNREGISTERED']) FROM base WHERE n = 8 UNION SELECT review_id, 'EVIDENCE_UNLINKED' FROM base WHERE n = 9 UNION SELECT review_id, 'EVIDENCE_LINKED_TWICE' FROM base WHERE n IN (10, 11)
        UNION SELECT review_id, unnest(['LINK_OUT_OF_SCOPE', 'EVIDENCE_UNASSIGNED']) FROM base WHERE n = 11 UNION SELECT review_id, 'FINDING_OUT_OF_SCOPE' FROM r WHERE n = 12 UNION SELECT review_id, 'CONFLICT_OUT_OF_SCOPE' FROM t WHERE review_id % 60 = 13 UNION SELECT review_id, 'COVERAGE_OUT_OF_SCOPE' FROM t WHERE review_id % 60 IN (14, 15, 16)
        UNION SELECT review_id, 'EVIDENCE_OUT_OF_PLACE' FROM base b WHERE hunk_id IS NOT NULL AND NOT EXISTS (FROM t JOIN place p USING (review_id, finding_id) WHERE t.review_id = b.review_id AND p.file_path = b.file_path AND p.hunk_id = b.hunk_id AND p.side = b.side AND p.start_line <= b.end_line AND b.start_line <= p.end_line)
        UNION SELECT review_id, 'UNSUPPORTED_STATUS' FROM base WHERE n >= 12 AND (review_id, finding_id) NOT IN (SELECT review_id, finding_id FROM proven))"""
_R = ("finding", "evidence", "place")


def _applied(f: DataFrame, e: DataFrame, p: DataFrame) -> DataFrame:
    second = _second(f, e, p)
    return recheck.apply_findings(second["finding"], recheck.accepted(second["finding_resolution"], recheck.violations(**second))).select("review_id", "finding_id", "status")


def _appended(f: DataFrame, e: DataFrame, p: DataFrame) -> DataFrame:
    second = _second(f, e, p)
    wrong = cut(recheck.violations(**second).select("review_id").distinct(), "wrong")
    out = recheck.apply_evidence(second["original"], recheck.accepted(second["added"], wrong), recheck.accepted(second["added_link"], wrong), second["finding"])
    return out.where("evidence_id like 'new-%'").select("review_id", "artifact_id", "evidence_id")


add_sliced("k03_k05_scope", lambda f, e, p: recheck.violations(**_second(f, e, p)), *_R, sql=_SECOND + " SELECT * FROM broken", grows=3)
add_sliced("k04_apply", _applied, *_R, sql=_SECOND + " SELECT f1.review_id, f1.finding_id, CASE WHEN f1.review_id % 60 >= 12 AND f1.review_id NOT IN (SELECT review_id FROM broken) AND EXISTS (FROM base b WHERE b.review_id = f1.review_id AND b.finding_id = f1.finding_id) THEN 'confirmed' ELSE f1.status END AS status FROM f1", grows=3)
add_sliced("k04_evidence", _appended, *_R, sql=_SECOND + " SELECT b.review_id, f1.artifact_id, 'new-' || b.evidence_id AS evidence_id FROM base b JOIN f1 ON f1.review_id = b.review_id AND f1.finding_id = b.finding_id WHERE b.review_id NOT IN (SELECT review_id FROM broken) AND n <> 5", grows=3)
add("k04_conflicts", lambda c: recheck.apply_conflicts(c, c.where("review_id % 3 = 0").select("review_id", "conflict_id")).select("review_id", "conflict_id", "entry", "resolved"), "conflict", sql="SELECT review_id, conflict_id, entry, resolved OR review_id % 3 = 0 AS resolved FROM conflict")
add("k04_coverage", lambda c: recheck.replace_coverage(c, c.where("status = 'failed' and review_id % 3 = 0").select("review_id", "skill", F.lit("completed").alias("status")).distinct()).select("coverage_id", "status", "error_code"), "coverage", sql="SELECT coverage_id, CASE WHEN status = 'failed' AND review_id % 3 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN NOT (status = 'failed' AND review_id % 3 = 0) THEN error_code END AS error_code FROM coverage")


def _rerun(c: DataFrame) -> DataFrame:
    one = c.dropDuplicates(["review_id", "skill"])
    result, update = recheck.rerun(one.where("status <> 'completed'").select("review_id", "skill", F.lit(None).cast("string").alias("route_id")), one.select("review_id", "skill", F.when(F.col("review_id") % 4 == 0, "completed").otherwise(F.col("status")).alias("status"), "error_code"), one.where("review_id % 8 = 0 and skill = 'detect_secret'").select("review_id", "skill"))
    return result.join(update.groupBy("review_id").agg(F.count("*").alias("updates")), "review_id", "left").fillna(0, ["updates"]).select("review_id", "status", "failure_reason", "updates")


add("k06_rerun", _rerun, "coverage", sql=""", one AS (SELECT DISTINCT ON (review_id, skill) * FROM coverage), asked AS (SELECT * FROM one WHERE status <> 'completed'), again AS (SELECT review_id, bool_or(review_id % 4 <> 0 AND status = 'failed') AS failed, bool_or(review_id % 8 = 0 AND skill = 'detect_secret') AS hot, count(*) AS n FROM asked WHERE skill LIKE 'detect%' GROUP BY review_id)
    SELECT review_id, CASE WHEN coalesce(failed OR hot, false) THEN 'failed' ELSE 'success' END AS status, CASE WHEN failed THEN 'FAILED_AGAIN' WHEN hot THEN 'NEW_RISK' END AS failure_reason, CASE WHEN coalesce(failed OR hot, true) THEN 0 ELSE n END AS updates FROM (SELECT DISTINCT review_id FROM asked) LEFT JOIN again USING (review_id)""")
add_gate("k02_exhausted", lambda g: policy.decided(recheck.exhausted(g.rules, g.r["review"].where("review_id % 3 = 0"))).select("review_id", "status", joined("rule_ids")), _GATE + " SELECT review_id, CASE WHEN status = 'PASS' AND review_id % 3 = 0 THEN 'NEEDS_REVIEW' ELSE status END AS status, CASE WHEN status = 'FAILED' OR review_id % 3 <> 0 THEN array_to_string(ids, ',') ELSE array_to_string(list_sort(list_distinct([x for x in ids if x <> 'P001'] || ['N008'])), ',') END AS rule_ids FROM verdict")
