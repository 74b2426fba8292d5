"""The queries that SQL can express against their DuckDB oracle, as the driver checks them."""

import pytest

import __spark_entry__ as entry
from mercato.llm import queries
from oracle_compare import digest, duck_connect

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.ORACLE) <= set(queries.QUERIES) & set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    s = digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck_connect(SMALL).execute(queries.ORACLE[name])
    o = digest([d[0] for d in cur.description], cur.fetchall())
    assert (s[0], s[1]) == (o[0], o[1])
    assert s[2] == o[2], f"{sorted(set(s[3]) - set(o[3]))[:3]} vs {sorted(set(o[3]) - set(s[3]))[:3]}"
