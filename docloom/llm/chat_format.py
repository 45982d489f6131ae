"""Chat formatting by perspective rotation.

A conversation is rendered once for every participant: that speaker's turns are the assistant's, every other speaker's
are a named user's, and context roles (system) stay what they are and are nobody's perspective. A rendering is the
segments of its turns, in order, one after the other. Each segment is a row with its place in the rendering and the place
of the part to train on: the assistant's own text and the end mark after it.

Places come from sums in two levels (runs of TURNS_TOGETHER turn numbers, then the turns within a run), so that not even a
conversation with a third of all rows is one task's work.

Cases: null text is empty; a turn with a null role is a user named unknown, and is nobody's perspective; rows that repeat
a turn are ordered by role and text; a null turn number comes first; conversations of context roles alone have no
rendering, as nobody speaks; a very long text is one segment; an end mark that stands inside a text is not escaped, and is
told from the segment's own by its place; null conversation ids are one conversation; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
TURNS_TOGETHER = 64


def rotate_perspectives(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """(conv_id, perspective, turn, role, label, segment, start, end, train_start, train_end) for conv_id, turn, role, text. Places are characters of the rendering."""
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    context = F.coalesce(F.col("role").isin(*context_roles), F.lit(False))
    speakers = said.filter(F.col("role").isNotNull() & ~context).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    label = F.when(context, F.col("role")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(F.lit("<|"), label, F.when(context | own, F.lit("")).otherwise(F.concat(F.lit(" name="), F.coalesce("role", F.lit("unknown")))), F.lit("|>\n"))
    rows = said.join(speakers, said["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")
    rows = rows.select("conv_id", "perspective", "turn", "role", "text", label.alias("label"), head.alias("head"), own.alias("own"), F.floor(F.col("turn") / TURNS_TOGETHER).alias("run"))
    rows = rows.withColumn("segment", F.concat("head", "text", F.lit("\n<|end|>\n"))).withColumn("size", F.length("segment").cast("long"))

    key = ["conv_id", "perspective"]
    runs = rows.groupBy(*key, "run").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in (*key, "run")], before.alias("base"))
    same = rows["conv_id"].eqNullSafe(runs["_conv_id"]) & (rows["perspective"] == runs["_perspective"]) & rows["run"].eqNullSafe(runs["_run"])
    within = F.sum("size").over(Window.partitionBy(*key, "run").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(runs, same).withColumn("end", F.col("base") + within).withColumn("start", F.col("end") - F.col("size"))
    return placed.select(
        *key,
        "turn",
        "role",
        "label",
        "segment",
        "start",
        "end",
        F.when(F.col("own"), F.col("start") + F.length("head")).alias("train_start"),
        F.when(F.col("own"), F.col("end")).alias("train_end"),
    )


def render(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans): whole renderings in one row each, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "train_start", "train_end")))
    return rotated.groupBy("conv_id", "perspective").agg(parts.alias("p")).select("conv_id", "perspective", F.array_join("p.segment", "").alias("text"), F.filter(F.transform("p", lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end"))), lambda x: x["start"].isNotNull()).alias("spans"))


SQL = """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations
), r AS (
  SELECT t.*, s.role AS perspective, t.role IS NOT DISTINCT FROM s.role AS own,
    CASE WHEN t.role = 'system' THEN 'system' WHEN t.role IS NOT DISTINCT FROM s.role THEN 'assistant' ELSE 'user' END AS label
  FROM t JOIN (SELECT DISTINCT conv_id, role FROM t WHERE role IS NOT NULL AND role <> 'system') s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), h AS (
  SELECT *, '<|' || label || CASE WHEN label = 'user' THEN ' name=' || coalesce(role, 'unknown') ELSE '' END || '|>' || chr(10) AS head FROM r
), g AS (
  SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS segment FROM h
), p AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM g
)
SELECT conv_id, perspective, turn, role, label, segment, "end" - length(segment) AS start, "end",
  CASE WHEN own THEN "end" - length(segment) + length(head) END AS train_start, CASE WHEN own THEN "end" END AS train_end FROM p
"""
