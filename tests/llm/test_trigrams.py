"""The registered trigram model against DuckDB."""

import duckdb

import __spark_entry__

SF, NAME = "/root/testdata/sf0.001", "op9_backoff_lm_order3"


def test_trigrams_are_registered_and_equal_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    show = lambda rows: sorted(tuple(f"{v:.9g}" if v is not None else "" for v in r) for r in rows)
    got = __spark_entry__.queries()[NAME](spark, SF).select("doc_id", "n_words", "n_unigram", "log_score_micro", "mean_log_score").collect()
    assert show(got) == show(c.sql(__spark_entry__.oracle_sql()[NAME]).fetchall())
    two = __spark_entry__.queries()["op9_backoff_lm_order2"](spark, SF).collect()
    assert show(__spark_entry__.queries()["op9_backoff_lm"](spark, SF).select(*got[0].__fields__).collect()) == show(got)
    assert {(r.doc_id, r.log_score_micro) for r in got} != {(r.doc_id, r.log_score_micro) for r in two}
