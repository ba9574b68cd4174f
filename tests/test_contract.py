"""The driver contract: every registered query against its DuckDB oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tablescope.plans.catalog import TABLES
from tools.oracle_check import digest

from conftest import SF_SMOKE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["age_group", "age_group_ordinal"] and len(rows) == 5


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMOKE).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    c1, h1, r1 = digest(got)
    c2, h2, r2 = digest(want)
    assert c1 == c2
    assert len(got) == len(want)
    assert h1 == h2, (sorted(set(r1) - set(r2))[:3], sorted(set(r2) - set(r1))[:3])
