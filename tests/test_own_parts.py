"""Queries that few relations tell write no facts on their way, and give what their SQL gives."""

import pytest
from compare import differences, duck
from test_slices import SF, _tables

from sievework.plans import catalogue, registry


@pytest.mark.parametrize("name", ["d05_c07_location", "d02_interval_support", "d01_dangling", "d06_unverified_e3", "d07_verified", "d09_d10_coverage_refs", "d03_route_overlap", "e08_coverage_gaps"])
def test_few_relations_make_no_facts(spark, name):
    registry.end_gates()
    before = _tables(spark)
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
    assert _tables(spark) == before


@pytest.mark.parametrize(("name", "unmade"), [("e05_e07_conflicts", {"evidence", "finding"}), ("u01_merged_conflicts", {"evidence", "finding"}), ("c09_e12_block", {"issues", "coverage", "covered"})])
def test_other_facts_are_not_made(spark, name, unmade):
    registry.end_gates()
    before = _tables(spark)
    assert differences(catalogue.QUERIES[name](spark, SF), duck(SF), catalogue.ORACLES[name]) == ""
    assert not {t.rsplit("-", 1)[0] for t in _tables(spark) - before} & unmade
    registry.end_gates()
    assert _tables(spark) <= before


@pytest.mark.parametrize("name", ["k04_evidence", "k04_apply", "k03_k05_scope"])
def test_rechecks_go_in_smaller_slices(spark, monkeypatch, name):
    asked = []

    def stop(*a):
        asked.append(a[-1])
        raise InterruptedError

    monkeypatch.setattr(registry, "_slices", stop)
    with pytest.raises(InterruptedError):
        catalogue.QUERIES[name](spark, SF)
    assert asked == [3]
