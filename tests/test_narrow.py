"""Queries that need facts of few records make no facts of the others, whole and in slices, with the results of their SQL."""

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from sievework.operators import gate, recheck, validation
from sievework.plans import catalogue, registry

SF = "/root/testdata/sf0.001"
NARROW = ["e02_e03_canonical_findings", "e04_canonical_evidence", "p03_b004"]


@pytest.mark.parametrize("name", NARROW)
def test_facts_of_all_records_are_not_made(spark, name):
    registry.end_gates()
    own = registry.shared_gate(spark, SF)
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
    assert not {"finding", "evidence", "coverage", "issues"} & set(own.__dict__)
    registry.end_gates()


@pytest.mark.parametrize("name", [*NARROW, "c08_qualified_evidence", "d22_e14_mandatory"])
def test_slices_give_the_same(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "_slices", lambda *_: [F.col("review_id") < 700, F.col("review_id") >= 700])
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""


def test_facts_shuffle_each_relation_once_a_key(spark, capsys):
    """Evidence goes by hunk and by id, coverage by id alone; neither by the artifact that it came in."""
    r = registry.shared_gate(spark, SF).r
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    evidence = validation.evidence_facts(r["evidence"], r["verified"], r["hunk"], r["artifact"])
    coverage = validation.coverage_facts(r["coverage"], r["coverage_route"], r["coverage_file"], r["route"], r["hunk"], r["artifact"])
    try:
        for facts in (evidence, coverage):
            facts.explain()
            plan = [line for line in capsys.readouterr().out.splitlines() if "hashpartitioning" in line]
            assert plan and not [line for line in plan if "artifact_id" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_issues_are_written_a_group_of_codes_at_a_time(spark, monkeypatch):
    parts = []
    before = gate.gathered
    monkeypatch.setattr(gate, "gathered", lambda name, made: parts.append((name, len(made))) or before(name, made))
    registry.end_gates()
    own = registry.shared_gate(spark, SF)
    assert differences(own.issues, duck(SF), catalogue.ORACLES["e10_all_issues"]) == ""
    assert parts == [("issues", len(own._parts()))]
    told = [code for codes, _ in own._parts() for code in codes]
    assert len(told) == len(set(told)), "a code in two groups could give a row twice"
    registry.end_gates()


@pytest.mark.parametrize("name", ["k01_requests", "w12_oversized"])
def test_counted_targets_are_not_located(spark, monkeypatch, name):
    asked = []
    before = recheck.targets
    monkeypatch.setattr(recheck, "targets", lambda gate, located=True: asked.append(located) or before(gate, located))
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
    assert asked == [False]


@pytest.mark.parametrize("name", ["u04_disjoint_buckets", "c10_buckets"])
def test_buckets_make_no_issues_of_all_reviews(spark, name):
    registry.end_gates()
    own = registry.shared_gate(spark, SF)
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
    assert not {"finding", "coverage", "covered", "issues", "flagged"} & set(own.__dict__)
    registry.end_gates()


@pytest.mark.parametrize("name", ["a20_markdown", "p11_reason", "p10_coherence"])
def test_decisions_write_flags_and_no_issues(spark, name):
    registry.end_gates()
    own = registry.shared_gate(spark, SF)
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
    assert not {"finding", "issues"} & set(own.__dict__) and own.flagged.columns == ["review_id", "tampered"]
    registry.end_gates()


def test_flags_are_those_of_the_issues(spark):
    registry.end_gates()
    own = registry.shared_gate(spark, SF)
    flags = own.flagged.collect()
    del own.__dict__["flagged"]
    assert own.issues.count() and len(flags) == len({r.review_id for r in flags}) and set(flags) == set(own.flagged.collect())
    registry.end_gates()


@pytest.mark.parametrize("name", ["u04_disjoint_buckets", "c10_buckets", "p11_reason", "p10_coherence"])
def test_slices_of_decisions_give_the_same(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "_slices", lambda *_: [F.col("review_id") < 700, F.col("review_id") >= 700])
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
