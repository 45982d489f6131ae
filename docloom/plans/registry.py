"""Named queries over the given tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql: what DuckDB runs on the same tables."""

    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _oracle[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from docloom.plans import relational_queries, scalar_queries, search_queries, service_queries, stream_queries, table_queries, workbook_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over documents with the benchmark's questions."""
    from docloom.plans.relational_queries import bm25_top_k

    return bm25_top_k(spark, sf_dir)
