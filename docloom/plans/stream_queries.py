"""Queries for stateful and page-wise operators; most are beyond SQL and tested by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import layout
from docloom.operators.phrases import lookup_phrases, named_phrases
from docloom.plans.registry import query, table
from docloom.plans.scalar_queries import _BOXES, boxes
from docloom.streaming.guard import guard_tokens, static_tokens
from docloom.streaming.limiter import limit_events


@query(
    "k04_rate_limit",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, false AS passed, CAST([] AS DOUBLE[]) AS kept FROM e
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.ts, len(list_filter(g.kept, lambda x: x > e.t - 3600)) < 3, CASE WHEN len(list_filter(g.kept, lambda x: x > e.t - 3600)) < 3 THEN list_append(list_filter(g.kept, lambda x: x > e.t - 3600), e.t) ELSE list_filter(g.kept, lambda x: x > e.t - 3600) END FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, event_id, ts, passed FROM g WHERE i > 0""",
)
def _(spark, sf):
    return limit_events(table(spark, sf, "events"), "user_id", "ts", "event_id", 3, 3600.0)


@query("k07_static_tokens", "SELECT conv_id, turn, i - 1 AS seq, CASE WHEN i > 1 THEN ' ' ELSE '' END || w[i] AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), unnest(range(1, len(w) + 1)) t(i)")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(static_tokens(F.col("text"))).alias("seq", "token"))
    return rows.withColumn("seq", F.col("seq").cast("long"))


@query("k03_guarded_tokens", "SELECT conv_id * 100 + turn AS answer, string_agg(text, '') AS text FROM conversations GROUP BY 1")
def _(spark, sf):
    said = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer"), "text")
    tokens = said.select("answer", F.posexplode(F.split("text", "(?<=\\n)")).alias("seq", "token"))
    out = guard_tokens(tokens, "answer", "seq", "token")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "released")))
    return out.groupBy("answer").agg(F.array_join(F.transform(ordered, lambda x: x["released"]), "").alias("text"))


def _flat(spark, sf):
    b = F.col("box")
    return boxes(spark, sf).select("page", "ord", b[0].alias("x0"), b[1].alias("top"), b[2].alias("x1"), b[3].alias("bottom"))


#: Boxes of a page one after the other, numbered from 1.
_ORDERED = f"b AS (SELECT page, ord, CAST(x0 AS DOUBLE) AS x0, CAST(top AS DOUBLE) AS top, CAST(x1 AS DOUBLE) AS x1, CAST(bottom AS DOUBLE) AS bottom, row_number() OVER (PARTITION BY page ORDER BY ord, x0, top, x1, bottom) AS i FROM ({_BOXES}))"


@query(
    "e11_lines",
    f"""WITH RECURSIVE {_ORDERED}, g AS (SELECT page, i, ord, 0 AS line, top AS ft, bottom - top AS fh, x1 AS px FROM b WHERE i = 1
UNION ALL SELECT b.page, b.i, b.ord, CASE WHEN abs(b.top - ft) > 0.6 * fh OR b.x0 - px > greatest(4 * fh, 30) THEN line + 1 ELSE line END, CASE WHEN abs(b.top - ft) > 0.6 * fh OR b.x0 - px > greatest(4 * fh, 30) THEN b.top ELSE ft END, CASE WHEN abs(b.top - ft) > 0.6 * fh OR b.x0 - px > greatest(4 * fh, 30) THEN b.bottom - b.top ELSE fh END, b.x1 FROM g JOIN b ON b.page = g.page AND b.i = g.i + 1)
SELECT page, ord, line FROM g""",
)
def _(spark, sf):
    return layout.per_page(_flat(spark, sf), "page", "ord", layout.line_numbers, "line")


@query(
    "e13_row_bands",
    f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT page, 0.65 * median(bottom - top) AS reach FROM b GROUP BY page),
g AS (SELECT page, i, ord, CAST(0 AS BIGINT) AS band, [top] AS tops FROM b WHERE i = 1
UNION ALL SELECT b.page, b.i, b.ord, coalesce(list_position(list_transform(g.tops, lambda t: abs(t - b.top) <= reach), true) - 1, len(g.tops)), CASE WHEN list_position(list_transform(g.tops, lambda t: abs(t - b.top) <= reach), true) IS NULL THEN list_append(g.tops, b.top) ELSE g.tops END FROM g JOIN b ON b.page = g.page AND b.i = g.i + 1 JOIN r ON r.page = b.page)
SELECT page, ord, band FROM g""",
)
def _(spark, sf):
    return layout.per_page(_flat(spark, sf), "page", "ord", layout.row_bands, "band")


@query(
    "d12_box_clusters",
    f"""WITH RECURSIVE {_ORDERED}, e AS (SELECT a.page, a.i AS u, c.i AS v FROM b a JOIN b c ON a.page = c.page AND a.x0 - 8 <= c.x1 + 8 AND c.x0 - 8 <= a.x1 + 8 AND a.top - 8 <= c.bottom + 8 AND c.top - 8 <= a.bottom + 8),
g AS (SELECT page, u, v FROM e UNION SELECT g.page, g.u, e.v FROM g JOIN e ON e.page = g.page AND e.u = g.v),
m AS (SELECT page, u, min(v) AS root FROM g GROUP BY ALL)
SELECT b.page, ord, dense_rank() OVER (PARTITION BY b.page ORDER BY root) - 1 AS cluster FROM b JOIN m ON m.page = b.page AND m.u = b.i""",
)
def _(spark, sf):
    return layout.per_page(_flat(spark, sf), "page", "ord", layout.clusters, "cluster")


@query(
    "f11_hero_boxes",
    f"""WITH {_ORDERED}, x AS (SELECT o.*, greatest(least(o.x1, f.x1) - greatest(o.x0, f.x0), 0) * greatest(least(o.bottom, f.bottom) - greatest(o.top, f.top), 0) AS common, (o.x1 - o.x0) * (o.bottom - o.top) + (f.x1 - f.x0) * (f.bottom - f.top) AS areas FROM b o JOIN b f ON o.page = f.page AND f.i = 1 WHERE o.i > 1)
SELECT page, ord, 0 AS place FROM b WHERE i = 1 UNION ALL SELECT page, arg_min(ord, i), 1 FROM x WHERE NOT (areas - common > 0 AND common / (areas - common) > 0.6) GROUP BY page""",
)
def _(spark, sf):
    def chosen(boxes):
        kept = layout.keep_apart(boxes)
        return [kept.index(i) if i in kept else None for i in range(len(boxes))]

    return layout.per_page(_flat(spark, sf), "page", "ord", chosen, "place")


@query("h03_named_phrases")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", named_phrases(F.col("text")).alias("phrases"))


@query("h05_lookup_phrases")
def _(spark, sf):
    asked = F.concat_ws(" ", "p_brand", "p_name")
    return table(spark, sf, "part").select("p_partkey", lookup_phrases(asked).alias("phrases"))
