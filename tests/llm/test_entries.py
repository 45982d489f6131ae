"""The registered queries of the subpackage with SQL, against DuckDB, and all of them by name."""

import duckdb
import pytest

from docloom.llm import entries

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entries.queries()[name](spark, SF)
    found = c.sql(entries.oracle_sql()[name])
    order = sorted(df.columns)
    at = [found.columns.index(x) for x in order]
    show = lambda v: f"{v:.9g}" if isinstance(v, (int, float)) else str(v)
    assert sorted(tuple(show(r[x]) for x in order) for r in df.collect()) == sorted(tuple(show(r[i]) for i in at) for r in found.fetchall())
