"""Column labels of every part, also beyond three letters."""

import duckdb

from docloom.plans import registry


def test_labels_of_any_length(spark, tmp_path):
    keys = [0, 1, 26, 27, 702, 703, 18278, 18279, 19999, 475254, 475255, 10**9]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.label for r in registry.queries()["h18_column_label_all"](spark, str(tmp_path)).collect()}
    assert list(got) and set(got) == set(keys) and got[18279] == "AAAA" and got[475255] == "AAAAA" and got[0] == ""
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == dict(c.sql(registry.oracle_sql()["h18_column_label_all"]).fetchall())
