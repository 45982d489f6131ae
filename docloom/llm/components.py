"""Connected components of an edge table by alternating large and small stars (joins and minimum aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._storage import discard, measured, sent


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(sent(least, 2 * n), "u").filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the smallest of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    passed = edges.join(sent(least, n), "a")
    return passed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b")


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """((node, root) of every node that isn't its own root, their number); root is the smallest node of its component.

    edges: columns a and b. A star's centre costs a partial aggregate and a join that Spark can split; nothing of a
    component meets in one task.
    """
    digest = F.sum(F.xxhash64("a", "b") % (1 << 40))
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = measured(now, "edges", digest=digest)
    while seen["n"]:
        before, old = seen, now
        now, seen = measured(_small_star(_large_star(now, seen["n"]), seen["n"]).distinct(), "edges", digest=digest)
        discard(old)
        if seen == before:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._staged_path = now._staged_path
    return out, seen["n"]
