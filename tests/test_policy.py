"""A closed world that passes, and one change at a time; then failures of the policy and of the gate."""

import os

import pytest

from sievework.operators import cycles, gate, policy
from sievework.operators.gate import Gate
from sievework.scratch import scratch_root

FINDING = dict(artifact_id="a1", finding_id="f1", category="secret", severity="high", status="confirmed", fingerprint="x", confidence_pct=90)
PLACE = dict(finding_id="f1", file_path="src/app.py", hunk_id="h1", side="new", start_line=10, end_line=10, snippet_hash="s")
EVIDENCE = dict(artifact_id="a1", evidence_id="e1", level="E3", source="rule", detector_name="detect_secret", detector_version="1.0.0", file_path="src/app.py", start_line=10, end_line=10, side="new", hunk_id="h1", snippet_hash="s", content_hash="c")
SKILLS = ["detect_secret", "security_semantic_review", "review_code_quality"]
COVERAGE = [dict(artifact_id="a1", coverage_id=f"c{i}", skill=s, status="completed", error_code=None, mandatory=True, routes=[], files=["src/app.py"]) for i, s in enumerate(SKILLS)]
SECURITY = dict(artifact_id="a1", schema_name="SecurityReview", schema_version="1.0.0", agent_id="security-scanner", agent_role="Security Scanner", status="success", own_review_id=1)
QUALITY = dict(artifact_id="a2", schema_name="QualityReview", schema_version="1.0.0", agent_id="quality-reviewer", agent_role="Quality Reviewer", status="success", own_review_id=1)
REVIEW = dict(trace_id="t", decided_at="2026-01-01", diff_review_id=1, risk_review_id=1, truncated=False, unsupported=False, repair_exhausted=False, recheck_exhausted=False)
SPOT = dict(file_path="src/app.py", start_line=10, end_line=10, side="new", hunk_id="h1", snippet_hash="s")
ROUTE = dict(route_id="r1", category="sql_injection", skill="detect_injection", mandatory=True, places=[SPOT])
CONFLICT = dict(conflict_id="x1", entry=1, type="contradiction", resolved=False, finding_id="f1", rule_id=None)
TYPES = {"mandatory": "boolean", "truncated": "boolean", "unsupported": "boolean", "repair_exhausted": "boolean", "recheck_exhausted": "boolean", "resolved": "boolean", "start_line": "int", "end_line": "int", "confidence_pct": "int", "entry": "int", "own_review_id": "long", "diff_review_id": "long", "risk_review_id": "long"}
BASE = {
    "review": [REVIEW], "artifact": [SECURITY, QUALITY], "lineage": [dict(artifact_id="a1", parent_id="root")], "root": [dict(root_id="root")], "finding": [], "place": [], "evidence": [], "link": [], "verified": [],
    "hunk": [dict(hunk_id="h1", new_path="src/app.py", old_path="src/app.py")], "route": [], "coverage": COVERAGE, "conflict": [],
}
KEYS = {"lineage": dict(artifact_id="", parent_id=""), "root": dict(root_id=""), "finding": FINDING, "place": PLACE, "evidence": EVIDENCE, "link": dict(finding_id="", evidence_id=""), "verified": dict(evidence_id=""), "route": {c: v for c, v in ROUTE.items() if c != "places"}, "conflict": CONFLICT, "coverage": {c: v for c, v in COVERAGE[0].items() if c not in ("routes", "files")}, "coverage_route": dict(coverage_id="", route_id=""), "coverage_file": dict(coverage_id="", file_path=""), "route_place": dict(route_id="", **SPOT)}
ONE = {"finding": [FINDING], "place": [PLACE], "evidence": [EVIDENCE], "link": [dict(finding_id="f1", evidence_id="e1")], "verified": [dict(evidence_id="e1")]}
LOW = {"finding": [FINDING | dict(severity="low")]}


def bridges(told):
    """Lists of routes, files and places as relations of their own."""
    out = told | {"route_place": [], "coverage_route": [], "coverage_file": []}
    for name, key, parts in (("coverage", "coverage_id", {"coverage_route": ("routes", "route_id"), "coverage_file": ("files", "file_path")}), ("route", "route_id", {"route_place": ("places", None)})):
        for r in told[name]:
            for bridge, (many, column) in parts.items():
                out[bridge] = [*out[bridge], *({key: r[key]} | ({column: x} if column else x) for x in r[many])]
        out[name] = [{c: v for c, v in r.items() if c not in ("routes", "files", "places")} for r in told[name]]
    return out


def world(spark, *cases):
    """The relations of one review a case, numbered from 1; a review id of 1 in a row stands for its own."""
    relations = {}
    worlds = [bridges(BASE | c) for c in cases or ({},)]
    for name in worlds[0]:
        columns = list(next((w[name][0] for w in worlds if w[name]), KEYS.get(name)))
        schema = ", ".join(["review_id long", *(f"{c} {TYPES.get(c, 'string')}" for c in columns)])
        own = lambda c, v, n: n if c.endswith("review_id") and v == 1 else n + 1000 if c.endswith("review_id") else v
        relations[name] = spark.createDataFrame([(n, *[own(c, r[c], n) for c in columns]) for n, w in enumerate(worlds, 1) for r in w[name]], schema)
    return relations


CASES = [
    ("a closed world passes", {}, ("PASS", ["P001"])),
    ("confirmed, high, E3 on the new side blocks", ONE, ("BLOCK", ["B001"])),
    ("command injection blocks", ONE | {"finding": [FINDING | dict(category="command_injection")], "evidence": [EVIDENCE | dict(detector_name="detect_injection")]}, ("BLOCK", ["B002"])),
    ("sql injection blocks", ONE | {"finding": [FINDING | dict(category="sql_injection")], "evidence": [EVIDENCE | dict(detector_name="detect_injection")]}, ("BLOCK", ["B003"])),
    ("E3 that no verifier registered", ONE | {"verified": []}, ("NEEDS_REVIEW", ["N004", "N006"])),
    ("a model's E1 never blocks", ONE | {"evidence": [EVIDENCE | dict(level="E1", source="llm")], "verified": []}, ("NEEDS_REVIEW", ["N004"])),
    ("several E2 are no E3", ONE | {"evidence": [EVIDENCE | dict(level="E2"), EVIDENCE | dict(level="E2", evidence_id="e2")], "verified": [], "link": [dict(finding_id="f1", evidence_id="e1"), dict(finding_id="f1", evidence_id="e2")]}, ("NEEDS_REVIEW", ["N004"])),
    ("evidence elsewhere supports nothing", ONE | {"evidence": [EVIDENCE | dict(start_line=12, end_line=12)]}, ("NEEDS_REVIEW", ["N004", "N006"])),
    ("any place of a finding may be supported", ONE | {"place": [PLACE | dict(start_line=1, end_line=1), PLACE]}, ("BLOCK", ["B001"])),
    ("one place outside the diff spoils a finding", ONE | {"place": [PLACE | dict(hunk_id="h9"), PLACE]}, ("NEEDS_REVIEW", ["N004", "N006"])),
    *[(f"mandatory coverage {s}", {"coverage": [COVERAGE[0] | dict(status=s, error_code="PARSE_ERROR" if s == "failed" else None), *COVERAGE[1:]]}, ("NEEDS_REVIEW", ["N001"])) for s in ("failed", "skipped", "not_applicable")],
    ("no secret coverage at all", {"coverage": COVERAGE[1:]}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("secret coverage marked optional", {"coverage": [COVERAGE[0] | dict(mandatory=False), *COVERAGE[1:]]}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("no coverage rows", {"coverage": []}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("a mandatory route without coverage", {"route": [ROUTE]}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("a mandatory route with optional coverage", {"route": [ROUTE], "coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="detect_injection", routes=["r1"], mandatory=False)]}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("a mandatory route with complete coverage", {"route": [ROUTE], "coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="detect_injection", routes=["r1"])]}, ("PASS", ["P001"])),
    ("one record may cover several routes", {"route": [ROUTE, ROUTE | dict(route_id="r2")], "coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="detect_injection", routes=["r1", "r2"])]}, ("PASS", ["P001"])),
    ("one record may cover several files", {"hunk": [*BASE["hunk"], dict(hunk_id="h2", new_path="src/b.py", old_path="src/b.py")], "coverage": [COVERAGE[0] | dict(files=["src/app.py", "src/b.py"]), *COVERAGE[1:]]}, ("PASS", ["P001"])),
    ("a route of several skills needs all of them", {"route": [ROUTE, ROUTE | dict(skill="detect_dangerous_call")], "coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="detect_injection", routes=["r1"])]}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("a record of one known and one unknown route", {"route": [ROUTE], "coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="detect_injection", routes=["r1", "r9"])]}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("the same record twice", {"coverage": [*COVERAGE, COVERAGE[0]]}, ("NEEDS_REVIEW", ["N001", "N006"])),
    ("a route with one place outside the diff", {"route": [ROUTE | dict(places=[SPOT, SPOT | dict(hunk_id="h9")])], "coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="detect_injection", routes=["r1"])]}, ("NEEDS_REVIEW", ["N006"])),
    ("optional coverage may fail", {"coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="other", mandatory=False, status="failed", error_code="TIMEOUT")]}, ("PASS", ["P001"])),
    ("a truncated diff", {"review": [REVIEW | dict(truncated=True)]}, ("NEEDS_REVIEW", ["N002"])),
    ("an unsupported or binary file", {"review": [REVIEW | dict(unsupported=True)]}, ("NEEDS_REVIEW", ["N002"])),
    ("an unresolved conflict disqualifies a blocker", ONE | {"conflict": [CONFLICT, CONFLICT | dict(finding_id=None, rule_id="N003")]}, ("NEEDS_REVIEW", ["N003", "N004"])),
    ("a resolved conflict does not", ONE | {"conflict": [CONFLICT | dict(resolved=True, rule_id="N003")]}, ("BLOCK", ["B001"])),
    ("a coverage gap with findings is a conflict", ONE | LOW | {"finding": [FINDING | dict(severity="low", category="sql_injection")], "route": [ROUTE | dict(mandatory=False)], "coverage": [*COVERAGE, COVERAGE[0] | dict(coverage_id="c9", skill="detect_injection", routes=["r1"], mandatory=False, status="skipped")]}, ("NEEDS_REVIEW", ["N003"])),
    ("medium findings need review", ONE | {"finding": [FINDING | dict(severity="medium")]}, ("NEEDS_REVIEW", ["N005"])),
    ("exhausted repair needs review", {"review": [REVIEW | dict(repair_exhausted=True)]}, ("NEEDS_REVIEW", ["N006"])),
    ("a failed service behind a mandatory check", {"coverage": [COVERAGE[0] | dict(status="failed", error_code="TIMEOUT"), *COVERAGE[1:]]}, ("NEEDS_REVIEW", ["N001", "N007"])),
    ("an exhausted recheck", {"review": [REVIEW | dict(recheck_exhausted=True)]}, ("NEEDS_REVIEW", ["N008"])),
    ("a required artifact is missing", {"artifact": [SECURITY]}, ("NEEDS_REVIEW", ["N006"])),
    *[(f"a required artifact with another {c}", {"artifact": [SECURITY, QUALITY | {c: v}]}, ("NEEDS_REVIEW", ["N006"])) for c, v in (("agent_id", "other"), ("agent_role", "Other"), ("schema_version", "2.0.0"), ("status", "failed"), ("own_review_id", 2))],
    ("a second artifact of a required schema", {"artifact": [SECURITY, QUALITY, SECURITY | dict(artifact_id="a3", agent_id="other")]}, ("NEEDS_REVIEW", ["N006"])),
    ("a block precedes incomplete coverage", ONE | {"coverage": [COVERAGE[0] | dict(status="failed", error_code="TIMEOUT"), *COVERAGE[1:]]}, ("BLOCK", ["B001", "N001", "N007"])),
    ("old-side evidence blocks nothing", ONE | {"place": [PLACE | dict(side="old")], "evidence": [EVIDENCE | dict(side="old")]}, ("NEEDS_REVIEW", ["N004"])),
    ("an old-side signal and tampering are no B004", ONE | {"place": [PLACE | dict(side="old")], "evidence": [EVIDENCE | dict(side="old")], "verified": [dict(evidence_id="e1"), dict(evidence_id="gone")]}, ("NEEDS_REVIEW", ["N004", "N006"])),
    ("an unknown detector", ONE | {"evidence": [EVIDENCE | dict(detector_version="9")]}, ("NEEDS_REVIEW", ["N004", "N006"])),
    ("tampering alone is no B004", {"lineage": [dict(artifact_id="a1", parent_id="gone")]}, ("NEEDS_REVIEW", ["N006"])),
    ("tampering and a strong signal are", ONE | {"finding": [FINDING | dict(category="logic")], "lineage": [dict(artifact_id="a1", parent_id="gone")]}, ("BLOCK", ["B004", "N006"])),
    ("low findings only warn", ONE | LOW, ("PASS", ["P001"])),
    ("dismissed findings are out", ONE | {"finding": [FINDING | dict(status="dismissed")]}, ("PASS", ["P001"])),
    ("a core without a trace fails", {"review": [REVIEW | dict(trace_id=" ")]}, ("FAILED", ["F001"])),
    ("a core of another review fails", {"review": [REVIEW | dict(diff_review_id=2)]}, ("FAILED", ["F001"])),
    ("repeated findings degrade", ONE | {"finding": [FINDING, FINDING | dict(artifact_id="a2")]}, ("NEEDS_REVIEW", ["N004", "N006"])),
    ("repeated conflicts degrade", ONE | LOW | {"conflict": [CONFLICT | dict(resolved=True, rule_id="N003"), CONFLICT | dict(resolved=True, rule_id="N003", entry=2)]}, ("NEEDS_REVIEW", ["N006"])),
    ("an unknown rule in a conflict", ONE | LOW | {"conflict": [CONFLICT | dict(resolved=True, rule_id="N999")]}, ("NEEDS_REVIEW", ["N006"])),
    ("an artifact of another review spoils what it holds", ONE | {"artifact": [SECURITY | dict(own_review_id=2), QUALITY]}, ("NEEDS_REVIEW", ["N001", "N004", "N006"])),
    ("a cycle in the lineage", {"lineage": [dict(artifact_id="a1", parent_id="a2"), dict(artifact_id="a2", parent_id="a1")]}, ("NEEDS_REVIEW", ["N006"])),
    ("coverage of a file outside the diff", {"coverage": [COVERAGE[0] | dict(files=["src/app.py", "src/other.py"]), *COVERAGE[1:]]}, ("NEEDS_REVIEW", ["N001", "N006"])),
]


@pytest.fixture(scope="module")
def decisions(spark):
    with Gate(**world(spark, *[c[1] for c in CASES])) as told:
        return {r.review_id: (r.status, r.rule_ids) for r in told.decisions.collect()}


@pytest.mark.parametrize(("review", "want"), [(n, c[2]) for n, c in enumerate(CASES, 1)], ids=[c[0] for c in CASES])
def test_decision_table(decisions, review, want):
    assert decisions[review] == want


def test_a_gate_ends_with_what_it_wrote(spark):
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with Gate(**world(spark, ONE)) as told:
        told.decisions.collect()
        assert set(os.listdir(root)) - before
    assert set(os.listdir(root)) == before


def test_without_a_policy_or_an_engine_every_review_fails(spark):
    relations = world(spark, ONE)
    assert [(r.status, r.rule_ids) for r in gate.safe_gate(None, **relations).collect()] == [("FAILED", ["F002"])]
    assert [(r.status, r.rule_ids) for r in gate.safe_gate(policy.FROZEN, **relations).collect()] == [("BLOCK", ["B001"])]
    broken = relations | {"evidence": relations["evidence"].drop("level")}
    assert [(r.status, r.rule_ids) for r in gate.safe_gate(policy.FROZEN, **broken).collect()] == [("FAILED", ["F003"])]


def test_a_policy_document_is_what_the_gate_asks_for(spark):
    told = {
        "policy_version": "v9", "always_required_skills": [], "provider_failure_error_codes": ["X"], "severity_rank": {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}, "evidence_rank": {"E0": 0, "E1": 1, "E2": 2, "E3": 3},
        "rule_ids": {"pass": "P001", "input_failure": "F001", "policy_failure": "F002", "engine_failure": "F003", "integrity_block": "B004"}, "required_artifacts": [], "e3_qualifiers": [{"source": "rule", "detector_name": "detect_secret", "detector_versions": ["1.0.0"]}],
        "block_rules": [{"rule_id": "B001", "categories": ["logic"], "statuses": ["suspected"], "min_severity": "low", "min_evidence_level": "E3", "require_new_side": True}], "needs_review_rules": [{"rule_id": "N004", "manual_action": "look"}],
    }
    own = policy.Policy.of(told)
    low = ONE | {"finding": [FINDING | dict(category="logic", severity="low", status="suspected")], "artifact": [SECURITY]}
    assert [(r.status, r.rule_ids) for r in Gate(own, **world(spark, low)).decisions.collect()] == [("BLOCK", ["B001"])]
    assert "v9" in Gate(own, **world(spark, dict(artifact=[SECURITY]))).decisions.first().reason
    with pytest.raises(ValueError, match="ranks"):
        policy.Policy.of(told | {"evidence_rank": {"E0": 0}})
    with pytest.raises(KeyError):
        policy.Policy.of({k: v for k, v in told.items() if k != "block_rules"})


def test_cycles():
    assert cycles.on_cycles([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("x", "y")]) == ["a", "b", "c", "e"]
    assert cycles.on_cycles([(str(i), str(i + 1)) for i in range(5000)]) == []


def test_the_plan_of_a_decision_is_small(spark):
    plan = Gate(**world(spark, ONE)).decisions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60 and "CartesianProduct" not in plan
