"""Every registered query with an oracle equals its DuckDB twin (sf0.001)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL).toPandas()
    ddf = con.execute(ORACLE[name]).df()
    assert compare(sdf, ddf) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["fraud_type", "n"]
    total = sum(r["n"] for r in rows)
    assert total == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_every_query_has_rows(spark):
    qs = entry.queries()
    for name in ["inject_nine_patterns", "inject_anomaly_patterns", "one_hot_learned"]:
        assert qs[name](spark, SF_SMALL).count() > 0
