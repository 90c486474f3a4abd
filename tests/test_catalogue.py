"""Every query gives the rows that its SQL gives, and some."""

import pytest
from compare import differences, duck

from sievework.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert connection.execute(f"SELECT count(*) FROM ({catalogue.ORACLES[name]})").fetchone()[0] > 0
    assert differences(catalogue.QUERIES[name](spark, SF), connection, catalogue.ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"review_id", "status", "rule_ids", "exit_code"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
