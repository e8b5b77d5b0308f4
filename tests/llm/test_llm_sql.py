"""Document queries against their SQL on the smallest tables."""
import duckdb
import pytest
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from check import TABLES, compare  # noqa: E402

from pulsegrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, cur = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    message = compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall())
    assert message is None or message.startswith("LAST DIGIT"), message


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
