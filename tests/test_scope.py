"""The scope of a recheck's results: all rules of one key off one shuffle, nulls and repeats included."""

from sievework.operators import recheck
from sievework.plans import gated
from sievework.plans.fixtures import relation

SF = "/root/testdata/sf0.001"
EVIDENCE = "review_id long, evidence_id string, finding_id string, level string, source string, file_path string, start_line long, end_line long, side string, hunk_id string"


def _result(spark, **own):
    """A result of review 1 that breaks no rule, with some relations replaced."""
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    spot = "array<struct<file_path:string,hunk_id:string,side:string,start_line:bigint,end_line:bigint>>"
    rows = {
        "request": ([(1, "q")], "review_id long, request_id string"), "target": ([(1, ["f"], "x", "s", "r", [("p", "h", "new", 1, 3)])], f"review_id long, finding_ids array<string>, conflict_id string, skill string, route_id string, places {spot}"),
        "original": ([(1, "old")], "review_id long, evidence_id string"), "finding": ([(1, "f")], "review_id long, finding_id string"), "result": ([(1, "q", 1, 1, "success")], "review_id long, given_request_id string, given_review_id long, attempt int, status string"),
        "added": ([(1, "e", "f", "E3", "rule", "p", 2, 2, "new", "h")], EVIDENCE), "added_link": ([(1, "f", "e")], "review_id long, finding_id string, evidence_id string"), "added_verified": ([(1, "e")], "review_id long, evidence_id string"),
        "finding_resolution": ([(1, "f", "confirmed")], "review_id long, finding_id string, status string"), "conflict_resolution": ([(1, "x")], "review_id long, conflict_id string"), "coverage_update": ([(1, "s", "r", True)], "review_id long, skill string, route_id string, mandatory boolean"),
    }
    out = recheck.violations(**{n: made(own.get(n, part), schema) for n, (part, schema) in rows.items()})
    return sorted(((r.review_id, r.rule) for r in out.collect()), key=str)


def test_keys_that_are_null_or_repeat(spark):
    same = (1, "e", "f", "E3", "rule", "p", 2, 2, "new", "h")
    assert _result(spark) == []
    assert _result(spark, added=[same, same]) == [(1, "EVIDENCE_REPEATED")]
    assert _result(spark, added=[same, (1, None, "f", "E1", "rule", None, None, None, None, None)]) == []
    assert _result(spark, added_link=[(1, "f", "e"), (1, "f", None), (1, None, "e")]) == [(1, "EVIDENCE_LINKED_TWICE")]
    assert _result(spark, finding_resolution=[(1, None, "dismissed")]) == [(1, "UNSUPPORTED_STATUS")]
    assert _result(spark, original=[(1, "e")]) == [(1, "EVIDENCE_NOT_NEW")]
    assert _result(spark, added_verified=[(1, None)]) == [(1, "E3_UNREGISTERED")]
    assert _result(spark, coverage_update=[(1, None, "r2", True), (1, "s", None, False)]) == [(1, "COVERAGE_OUT_OF_SCOPE")]
    none = (None, "e", "f", "E1", "rule", None, None, None, None, None)
    assert _result(spark, added=[same, none], original=[(None, "e"), (1, "old")], added_link=[(1, "f", "e"), (None, "f", "e")]) == [(None, "EVIDENCE_UNASSIGNED"), (None, "EVIDENCE_UNLINKED"), (None, "LINK_OUT_OF_SCOPE")]


def test_rules_of_a_key_share_a_shuffle(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        recheck.violations(**gated._second(*[relation(spark, SF, n) for n in gated._R])).explain()
        assert capsys.readouterr().out.count("hashpartitioning") < 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
