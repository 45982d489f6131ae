"""Unions that keep the first, the best or the last row of an id, and deletes and upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row a key, the first in order: a partial aggregate, so a hot key costs no window."""
    packed = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return packed.select("_r.*")


def keep_best(rows: DataFrame, key: str, score: str, tie: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(score), *[-F.col(c) for c in tie]))
    return rows.groupBy(key).agg(best.alias("_r")).select("_r.*")


def keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, with the place of its first."""
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"), F.min(F.struct(*order)).alias("first_seen"))
    return packed.select("_r.*", "first_seen")


def ordered_unique(rows: DataFrame, group: str, label: str, order: str, limit: int) -> DataFrame:
    """Caseless distinct labels of a group in their first spelling and order, at most limit."""
    each = rows.groupBy(group, F.lower(label).alias("_k")).agg(F.min_by(label, order).alias(label), F.min(order).alias("_o"))
    w = Window.partitionBy(group).orderBy("_o")
    return each.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("_k", "_o")


def upsert_latest(history: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """One row a key: for each column the latest value that isn't null (null leaves it unchanged)."""
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    return history.groupBy(key).agg(*latest)


def delete_by_key(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def mode_or_default(rows: DataFrame, group: str, value: str, default: str) -> DataFrame:
    """The commonest value; the default where several occur and the commonest has fewer than max(2, half)."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    each = counts.groupBy(group).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("top"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    unsure = (F.col("kinds") > 1) & (F.col("top") < F.greatest(F.lit(2), F.floor(F.col("total") / 2)))
    return each.select(group, F.when(unsure, default).otherwise(F.col(value)).alias(value))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, in order; null if none does."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out
