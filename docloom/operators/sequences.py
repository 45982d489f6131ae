"""Runs, gaps and fills over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def gap_clusters(rows: DataFrame, group: list[str], position: str, threshold: Column | float) -> DataFrame:
    """Clusters of positions: a new one where the gap to the one before exceeds the threshold. (group.., cluster, lo, hi, mean, n)"""
    w = Window.partitionBy(*group).orderBy(position)
    gap = F.col(position) - F.lag(position).over(w)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    starts = rows.withColumn("_new", F.when(gap > limit, 1).otherwise(0))
    numbered = starts.withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "cluster").agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.avg(position).alias("mean"), F.count("*").alias("n"))


def gutter_histogram(words: DataFrame, page: str, center: Column, width: float, bins: int = 30) -> DataFrame:
    """(page, bin, n, smooth): counts of centres by bin, empty bins too, and the mean of each with its neighbours."""
    counted = words.groupBy(page, F.least(F.floor(center / width * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = words.select(page).distinct().select(page, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    full = every.join(counted, [page, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.withColumn("smooth", F.avg("n").over(Window.partitionBy(page).orderBy("bin").rowsBetween(-1, 1)))


def first_row_where(rows: DataFrame, group: str, order: str, test: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.min(F.when(test, F.col(order))).alias(order))


def last_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def column_gutters(words: DataFrame, page: str, center: Column, width: float, bins: int = 30) -> DataFrame:
    """(page, gutter): where a page of two columns parts, null for one column.

    The valley of the smoothed histogram between its outer fifths, if it is at most 0.35 of the peak there, and either side has
    0.12 of 15 words or more.
    """
    smooth = gutter_histogram(words, page, center, width, bins).withColumn("h", F.when(F.col("bin").isin(0, bins - 1), F.col("n").cast("double")).otherwise(F.col("smooth")))
    inner = smooth.filter(F.col("bin").between(int(bins * 0.2), int(bins * 0.8) - 1))
    found = inner.groupBy(page).agg(F.min_by("bin", F.struct("h", "bin")).alias("valley"), F.min("h").alias("low"), F.max("h").alias("high"))
    placed = found.select(page, ((F.col("valley") + 0.5) * width / bins).alias("x"), "low", "high")
    sides = words.select(page, center.alias("_c")).join(placed, page).groupBy(page, "x", "low", "high").agg(F.count("*").alias("n"), F.count_if(F.col("_c") < F.col("x")).alias("left"))
    good = (F.col("n") >= 15) & (F.col("high") > 0) & (F.col("low") <= 0.35 * F.col("high")) & (F.col("left") >= 0.12 * F.col("n")) & (F.col("n") - F.col("left") >= 0.12 * F.col("n"))
    return sides.select(page, F.when(good, F.col("x")).alias("gutter"))


def reading_order(words: DataFrame, page: str, width: float) -> DataFrame:
    """words with band and place: the left column before the right one, lines from the top, words from the left. words: page, ord, x0, x1, top."""
    center = (F.col("x0") + F.col("x1")) / 2
    split = words.join(column_gutters(words, page, center, width), page).withColumn("band", F.when(center >= F.col("gutter"), 1).otherwise(0))
    return split.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("band", F.round("top", 1), "x0", "ord"))).drop("gutter")
