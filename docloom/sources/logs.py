"""Append-only logs: talks, events and audits of statements. An append that runs again adds nothing to what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str, stamp: str, key: list[str]) -> None:
    """Add rows to a log, in folders by the day of their stamp. key: what tells rows apart."""
    ident = F.sha2(F.to_json(F.struct(*key)), 256)
    rows.withColumn("log_id", ident).withColumn("day", F.to_date(stamp)).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Each row of a log once, however often it was appended; since: only the folders of that day and later are read."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since).cast("date"))
    return rows.dropDuplicates(["log_id"]).drop("log_id", "day")
