"""Every query against its SQL in DuckDB, on the smallest tables."""

import check
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    outcome, _, _ = check.compare(spark, db, name, QUERIES[name], SQL.get(name), SF)
    assert outcome.startswith(("ok", "rows-only")), outcome
    assert not outcome.endswith(" 0"), "nothing was compared"


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "pii_count", "sanitized"] and df.count() > 0
