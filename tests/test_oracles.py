"""Every registered query with an oracle equals its DuckDB twin at sf0.01."""
import os

import pytest

from oracle import compare, duck

from equiscope.plans.registry import load_all

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = load_all()
WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, con, name):
    q = QUERIES[name]
    problems = compare(q.build(spark, SF), con, q.sql)
    assert not problems, "\n".join(problems)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
