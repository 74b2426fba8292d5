"""Every registered query against its DuckDB oracle (row count, columns, order-insensitive
value hash), as the driver checks it. Runs at sf0.001 to keep the suite quick; the compare
script runs the same check at sf0.01."""

import pytest

import __spark_entry__ as entry
from mercato.plans.registry import all_queries
from oracle_compare import digest, duck_connect

from conftest import SF_SMALL

QUERIES = all_queries()      # the store's; those of the training-data subpackage have tests there
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    cur = duck.execute(sql)
    ocols = [d[0] for d in cur.description]
    s = digest(df.columns, rows)
    o = digest(ocols, cur.fetchall())
    assert s[0] == o[0], f"columns differ: {s[0]} vs {o[0]}"
    assert s[1] == o[1], f"row counts differ: {s[1]} vs {o[1]}"
    assert s[2] == o[2], f"values differ: {sorted(set(s[3]) - set(o[3]))[:3]} vs {sorted(set(o[3]) - set(s[3]))[:3]}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "spend_rank" in df.columns


def test_every_query_has_an_oracle():
    assert sorted(set(QUERIES) - set(entry.oracle_sql())) == []
