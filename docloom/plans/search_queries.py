"""Queries for search over one index: documents as chunks, embeddings as their vectors, the benchmark's items as questions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import policy as P
from docloom.functions import text as T
from docloom.operators import retrieval
from docloom.operators import search as S
from docloom.plans import relational_queries as R
from docloom.plans.registry import query, table

#: Chunks and questions in SQL; _chunks and _questions make the same.
_INDEX = """
chunks AS (SELECT d.doc_id AS chunk_id, d.doc_id // 3 AS doc_id, coalesce(text, '') AS content, lang AS user_id, CASE d.doc_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'table' ELSE 'text' END AS chunk_type,
  CASE WHEN d.doc_id % 3 < 2 THEN 'xlsx' ELSE 'pdf' END AS source_format, CAST(d.doc_id % 4 AS VARCHAR) AS sheet_name, CASE d.doc_id % 7 WHEN 0 THEN 'standalone' WHEN 1 THEN 'satellite' ELSE 'primary' END AS sheet_role, embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
questions AS (SELECT item_id AS query_id, text, embedding AS vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM questions),
t AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM chunks),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
bm AS (SELECT query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 4) AS score FROM p JOIN q USING (term) JOIN df USING (term) JOIN t USING (chunk_id), a GROUP BY query_id, p.chunk_id),
nn AS (SELECT query_id, chunk_id, user_id, chunk_type, round(list_distance(embedding::DOUBLE[], vector::DOUBLE[]), 6) AS d FROM chunks, questions WHERE embedding IS NOT NULL AND vector IS NOT NULL)"""


def _hybrid(k: int, scope: str) -> str:
    return f"""{_INDEX},
b1 AS (SELECT query_id, chunk_id, score FROM (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm.chunk_id) AS r FROM bm JOIN chunks USING (chunk_id) WHERE {scope}) WHERE r <= {k}),
v1 AS (SELECT query_id, chunk_id, 1 / (1 + d * d) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS r FROM nn) WHERE r <= {k} AND {scope}),
b2 AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM b1 WINDOW w AS (PARTITION BY query_id)),
v2 AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM v1 WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(b2.query_id, v2.query_id) AS query_id, coalesce(b2.chunk_id, v2.chunk_id) AS chunk_id, round(0.5 * coalesce(b2.s, 0) + 0.5 * coalesce(v2.s, 0), 6) AS score FROM b2 FULL OUTER JOIN v2 ON b2.query_id = v2.query_id AND b2.chunk_id = v2.chunk_id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= {k})"""


def _chunks(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        d.alias("chunk_id"), F.floor(d / 3).alias("doc_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("user_id"),
        F.when(d % 5 == 0, "image").when(d % 5 == 1, "table").otherwise("text").alias("chunk_type"),
        F.when(d % 3 < 2, "xlsx").otherwise("pdf").alias("source_format"), (d % 4).cast("string").alias("sheet_name"),
        F.when(d % 7 == 0, "standalone").when(d % 7 == 1, "satellite").otherwise("primary").alias("sheet_role"),
    )
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vectors, "chunk_id", "left")


def _questions(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id", "left")


@query("f01_hybrid_search", f"WITH {_hybrid(8, 'true')} SELECT query_id, chunk_id, score, rank FROM hy")
def _(spark, sf):
    return S.hybrid_search(_chunks(spark, sf), _questions(spark, sf), 8)


@query("b01_scoped_search", f"WITH {_hybrid(8, "user_id = 'en'")} SELECT query_id, chunk_id, score, rank FROM hy")
def _(spark, sf):
    return S.hybrid_search(_chunks(spark, sf), _questions(spark, sf), 8, S.scope_filter(user_id="en"))


@query("f12_image_search", f"WITH {_hybrid(4, "chunk_type = 'image'")} SELECT query_id, chunk_id, score, rank FROM hy WHERE rank <= 1")
def _(spark, sf):
    return S.image_search(_chunks(spark, sf), _questions(spark, sf), 4)


_CAPPED = """n AS (SELECT *, count(*) FILTER (WHERE source_format = 'xlsx') OVER (PARTITION BY query_id) AS n FROM hits),
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, sheet_name ORDER BY priority DESC, score DESC, length, chunk_id) AS b FROM n WHERE source_format = 'xlsx' AND n > {cap}) WHERE b = 1),
r1 AS (SELECT *, sheet_role NOT IN ('standalone', 'satellite') AS p, count(*) OVER (PARTITION BY query_id) AS reps, count(*) FILTER (WHERE sheet_role NOT IN ('standalone', 'satellite')) OVER (PARTITION BY query_id) AS np FROM reps),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY score DESC, length, chunk_id) AS i, least(reps - np, {cap} - CASE WHEN np > 0 THEN 1 ELSE 0 END) AS linked FROM r1),
capped AS (SELECT query_id, chunk_id, chunk_type, score FROM n WHERE source_format <> 'xlsx' OR n <= {cap} UNION ALL SELECT query_id, chunk_id, chunk_type, score FROM r2 WHERE reps <= {cap} OR CASE WHEN p THEN i <= {cap} - linked ELSE i <= linked END)"""


@query(
    "j06_search_documents",
    f"""WITH {_hybrid(8, 'true')}, d AS (SELECT hy.query_id, hy.chunk_id, hy.score, doc_id, chunk_type, source_format, sheet_name, sheet_role, length(content) AS length FROM hy JOIN chunks USING (chunk_id)),
ts AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_type = 'table' ORDER BY score DESC, chunk_id) AS tr, least(count(*) FILTER (WHERE chunk_type = 'table') OVER (PARTITION BY query_id), 2) AS tn FROM d),
hits AS (SELECT *, 0 AS priority FROM ts WHERE CASE WHEN chunk_type = 'table' THEN tr <= 2 ELSE tr <= 6 - tn END), {_CAPPED.format(cap=5)}
SELECT query_id, chunk_id, chunk_type, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM capped""",
)
def _(spark, sf):
    return S.search_documents(_chunks(spark, sf), _questions(spark, sf))


#: Every line of a sheet's chunk is a row of an entity.
_ENTITIES = "entities AS (SELECT chunk_id, 'e' || ((chunk_id + i) % 11) AS entity_key, line FROM (SELECT chunk_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM chunks WHERE source_format = 'xlsx'))"
_TELLING = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: regexp_matches(x, '[0-9]') OR (length(x) >= 2 AND NOT list_contains(" + str(T.STOP_WORDS) + ", x))))"


@query(
    "j06_search_with_anchors",
    f"""WITH {_hybrid(8, 'true')}, {_ENTITIES}, tk AS (SELECT query_id, {_TELLING} AS ts FROM questions),
d AS (SELECT hy.query_id, hy.chunk_id, hy.score, doc_id, chunk_type, source_format, sheet_name, sheet_role, length(content) AS length FROM hy JOIN chunks USING (chunk_id)),
ts0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_type = 'table' ORDER BY score DESC, chunk_id) AS tr, least(count(*) FILTER (WHERE chunk_type = 'table') OVER (PARTITION BY query_id), 2) AS tn FROM d),
slot AS (SELECT query_id, chunk_id, score, doc_id, chunk_type, source_format, sheet_name, sheet_role, length FROM ts0 WHERE CASE WHEN chunk_type = 'table' THEN tr <= 2 ELSE tr <= 6 - tn END),
er AS (SELECT s.query_id, s.doc_id, s.chunk_id, s.sheet_name, e.entity_key, s.score, CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda x: contains(lower(line), x))) / len(ts)::DOUBLE ELSE 0.0 END AS m FROM slot s JOIN entities e USING (chunk_id) JOIN tk USING (query_id)),
ab AS (SELECT query_id, doc_id, entity_key, max(m * greatest(score, 0.01)) AS best FROM er WHERE m >= 0.34 GROUP BY ALL),
an AS (SELECT query_id, doc_id, entity_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, doc_id, entity_key) AS place FROM ab) WHERE place <= 3),
ix AS (SELECT an.query_id, an.doc_id, an.entity_key, c.chunk_id, c.sheet_name, max(CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda x: contains(lower(line), x))) / len(ts)::DOUBLE ELSE 0.0 END) AS m FROM an JOIN chunks c USING (doc_id) JOIN entities e ON e.chunk_id = c.chunk_id AND e.entity_key = an.entity_key JOIN tk USING (query_id) GROUP BY ALL),
nw AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, doc_id, entity_key, sheet_name, arg_max(chunk_id, (m, -chunk_id)) AS chunk_id FROM ix WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.query_id = ix.query_id AND er.doc_id = ix.doc_id AND er.entity_key = ix.entity_key AND er.sheet_name = ix.sheet_name) GROUP BY ALL) n WHERE NOT EXISTS (SELECT 1 FROM slot WHERE slot.query_id = n.query_id AND slot.chunk_id = n.chunk_id)),
hits AS (SELECT slot.*, CASE WHEN EXISTS (SELECT 1 FROM er JOIN an ON er.query_id = an.query_id AND er.doc_id = an.doc_id AND er.entity_key = an.entity_key WHERE er.query_id = slot.query_id AND er.chunk_id = slot.chunk_id) THEN 2 ELSE 0 END AS priority FROM slot
  UNION ALL SELECT nw.query_id, c.chunk_id, 0.0, c.doc_id, c.chunk_type, c.source_format, c.sheet_name, c.sheet_role, length(c.content), 1 FROM nw JOIN chunks c USING (chunk_id)), {_CAPPED.format(cap=5)}
SELECT query_id, chunk_id, chunk_type, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM capped""",
)
def _(spark, sf):
    chunks = _chunks(spark, sf)
    lines = chunks.filter("source_format = 'xlsx'").select("chunk_id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    entities = lines.select("chunk_id", F.concat(F.lit("e"), ((F.col("chunk_id") + F.col("i")) % 11).cast("string")).alias("entity_key"), "line")
    return S.search_documents(chunks, _questions(spark, sf), entities=entities)


@query("f01_postings_top_k", R._BM25)
def _(spark, sf):
    """The keyword search of f01_bm25_top_k over an index that was written before, replaced in part, and cleared of what was replaced."""
    from docloom.operators import postings
    from docloom.sources.folders import shared_folder

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 3).alias("doc_id"), F.col("text").alias("content"))
    stale = docs.filter("doc_id % 5 = 0").withColumn("content", F.concat(F.lit("stale words "), F.coalesce("content", F.lit(""))))
    index = postings.Postings(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    index.append(docs.filter("doc_id % 5 <> 0").unionByName(stale), batch=1)
    index.replace(docs.filter("doc_id % 5 = 0"), batch=2)
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(retrieval.index_words(F.col("text")))).alias("term"))
    return index.top_k(terms, 6).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


#: Hits of a search: lines of an order are what a question found.
_HITS = "SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey % 4 AS doc_id, CASE WHEN l_returnflag = 'A' THEN 'text' ELSE 'table' END AS chunk_type, CASE WHEN l_linenumber = 1 THEN 'pdf' ELSE 'xlsx' END AS source_format, CAST(l_linenumber AS VARCHAR) AS sheet_name, CASE l_partkey % 3 WHEN 0 THEN 'standalone' WHEN 1 THEN 'satellite' ELSE 'primary' END AS sheet_role, l_extendedprice AS score, CAST(l_quantity AS BIGINT) AS length, CASE WHEN l_tax > 0.05 THEN 2 WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS priority FROM lineitem"


def _hits(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_partkey") % 3
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + n).alias("chunk_id"), (F.col("l_orderkey") % 4).alias("doc_id"), F.when(F.col("l_returnflag") == "A", "text").otherwise("table").alias("chunk_type"),
        F.when(n == 1, "pdf").otherwise("xlsx").alias("source_format"), n.cast("string").alias("sheet_name"), F.when(p == 0, "standalone").when(p == 1, "satellite").otherwise("primary").alias("sheet_role"),
        F.col("l_extendedprice").alias("score"), F.col("l_quantity").cast("long").alias("length"), F.when(F.col("l_tax") > 0.05, 2).when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("priority"),
    )


@query("f04_sheet_cap", f"WITH hits AS ({_HITS}), {_CAPPED.format(cap=5)} SELECT query_id, chunk_id FROM capped")
def _(spark, sf):
    return S.cap_sheets(_hits(spark, sf)).select("query_id", "chunk_id")


@query(
    "f05_context_budget",
    """WITH RECURSIVE h AS (SELECT conv_id, turn, role, length(text) AS length, 60 + length(text) AS size, (turn * 7 % 5) / 10.0::DOUBLE AS score, CASE turn % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'satellite' ELSE 'standalone' END AS sheet_role FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE sheet_role WHEN 'standalone' THEN 0 WHEN 'satellite' THEN 1 ELSE 2 END, score DESC, length, turn) AS i FROM h),
g AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, false AS kept, CAST(NULL AS BIGINT) AS turn FROM (SELECT DISTINCT conv_id FROM h)
  UNION ALL SELECT r.conv_id, r.i, CASE WHEN g.used + r.size + length(CAST(g.n + 1 AS VARCHAR)) + CASE WHEN g.n > 0 THEN 2 ELSE 0 END <= 1500 THEN g.used + r.size + length(CAST(g.n + 1 AS VARCHAR)) + CASE WHEN g.n > 0 THEN 2 ELSE 0 END ELSE g.used END,
  CASE WHEN g.used + r.size + length(CAST(g.n + 1 AS VARCHAR)) + CASE WHEN g.n > 0 THEN 2 ELSE 0 END <= 1500 THEN g.n + 1 ELSE g.n END, g.used + r.size + length(CAST(g.n + 1 AS VARCHAR)) + CASE WHEN g.n > 0 THEN 2 ELSE 0 END <= 1500, r.turn FROM g JOIN r ON r.conv_id = g.conv_id AND r.i = g.i + 1),
any_kept AS (SELECT conv_id, bool_or(kept) AS found_any FROM g GROUP BY conv_id)
SELECT g.conv_id, turn FROM g JOIN any_kept USING (conv_id) WHERE i > 0 AND (kept OR NOT found_any)""",
)
def _(spark, sf):
    t = F.col("turn")
    role = F.when(t % 3 == 0, "primary").when(t % 3 == 1, "satellite").otherwise("standalone")
    hits = table(spark, sf, "conversations").select("conv_id", t.alias("chunk_id"), role.alias("sheet_role"), ((t * 7 % 5) / 10).alias("score"), F.length("text").alias("length"), (60 + F.length("text")).alias("size"))
    return S.fit_context(hits, "conv_id", 1500).select("conv_id", F.col("chunk_id").alias("turn"))


@query(
    "f06_answer_context",
    """WITH h AS (SELECT source AS k, doc_id, lang, n_chars, text, row_number() OVER (PARTITION BY source, n_chars % 50 ORDER BY doc_id) AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT k, bucket, sha256(string_agg('--- Source ' || n || ' ---' || chr(10) || 'Document: f' || doc_id || chr(10) || CASE WHEN lang = 'de' THEN CASE WHEN n_chars % 2 = 0 THEN 'Section: s' || (n_chars % 7) || chr(10) ELSE '' END ELSE 'Page: ' || (doc_id % 9) || chr(10) END || 'Type: ' || CASE WHEN doc_id % 5 = 1 THEN 'table' ELSE 'text' END || chr(10) || 'Content:' || chr(10) || '<document_excerpt>' || chr(10) || coalesce(text, '') || chr(10) || '</document_excerpt>', chr(10) || chr(10) ORDER BY n)) AS digest FROM (SELECT *, n_chars % 50 AS bucket FROM h) GROUP BY ALL""",
)
def _(spark, sf):
    d, s = F.col("doc_id"), lambda c: c.cast("string")
    hits = table(spark, sf, "documents").select(
        F.struct(F.col("source").alias("k"), (F.col("n_chars") % 50).alias("bucket")).alias("g"), "doc_id", F.concat(F.lit("f"), s(d)).alias("filename"), F.when(F.col("lang") == "de", "docx").otherwise("pdf").alias("source_format"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("s"), s(F.col("n_chars") % 7))).otherwise(" ").alias("section"), (d % 9).alias("page_number"), F.when(d % 5 == 0, "image").when(d % 5 == 1, "table").otherwise("text").alias("chunk_type"), F.coalesce("text", F.lit("")).alias("content"),
    )
    return S.answer_context(hits, "g", ["doc_id"]).select("g.k", "g.bucket", F.sha2("context", 256).alias("digest"))


@query("b02_hit_rows", f"WITH {_hybrid(8, 'true')} SELECT query_id, chunk_id, doc_id, user_id, chunk_type, score, CASE WHEN chunk_type = 'image' THEN '/images/' || doc_id || '/' || chunk_id || '.png' END AS image_url FROM hy JOIN chunks USING (chunk_id)")
def _(spark, sf):
    chunks = _chunks(spark, sf)
    path = F.when(F.col("chunk_type") == "image", F.concat(F.lit("data/images/"), "user_id", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk_id").cast("string"), F.lit(".png")))
    hits = S.hybrid_search(chunks, _questions(spark, sf), 8)
    return S.hit_rows(hits, chunks.withColumn("image_path", path)).select("query_id", "chunk_id", "doc_id", "user_id", "chunk_type", "score", "image_url")


@query("b05_citations", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'docx' WHEN lang = 'fr' THEN 'xlsx' ELSE 'pdf' END AS source_format, left(text, 240) AS snippet, CASE WHEN lang = 'de' THEN CASE WHEN doc_id % 2 = 0 THEN n_chars END WHEN lang <> 'fr' THEN doc_id END AS bbox, CASE WHEN lang = 'de' THEN doc_id % 11 END AS viewer_page FROM documents")
def _(spark, sf):
    fmt = F.when(F.col("lang") == "de", "docx").when(F.col("lang") == "fr", "xlsx")
    hits = table(spark, sf, "documents").select("doc_id", fmt.alias("source_format"), F.col("text").alias("content"), F.col("doc_id").alias("bbox"), F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("missing").alias("viewer_status"), F.col("n_chars").alias("viewer_bbox"), (F.col("doc_id") % 11).alias("viewer_page"))
    return S.source_rows(hits)


@query("c19_image_sources", "WITH s AS (SELECT l_orderkey AS q, l_linenumber AS c, l_comment AS snippet, l_quantity AS score FROM (SELECT *, l_shipmode AS l_comment FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)) WHERE l_linenumber <= 4), i AS (SELECT l_orderkey AS q, l_linenumber AS c, l_linestatus AS caption, l_tax AS score FROM lineitem WHERE l_linenumber >= 3) SELECT coalesce(s.q, i.q) AS query_id, coalesce(s.c, i.c) AS chunk_id, CASE WHEN s.q IS NULL THEN 'image' ELSE 'text' END AS chunk_type, CASE WHEN s.q IS NULL THEN coalesce(caption, '') ELSE snippet END AS snippet, CASE WHEN s.q IS NULL THEN i.score ELSE s.score END AS score, CASE WHEN i.q IS NOT NULL THEN 'intent' END AS attach_reason FROM s FULL OUTER JOIN i ON s.q = i.q AND s.c = i.c")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("chunk_id"), "l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    sources = lines.filter("chunk_id <= 4").select("query_id", "chunk_id", F.lit("text").alias("chunk_type"), F.col("l_returnflag").alias("snippet"), F.col("l_quantity").alias("score"))
    images = lines.filter("chunk_id >= 3").select("query_id", "chunk_id", F.col("l_linestatus").alias("caption"), F.col("l_tax").alias("score"))
    return S.merge_image_sources(sources, images)


@query(
    "f07_table_ranking",
    f"""WITH {_hybrid(8, 'true')}, w AS (SELECT hy.query_id, hy.chunk_id, hy.score, coalesce(list_dot_product(c.embedding::DOUBLE[], questions.vector::DOUBLE[]), 0) AS sim, list_distinct(list_filter(regexp_split_to_array(lower(questions.text), '\\s+'), lambda x: x <> '')) AS qa, list_distinct(list_filter(regexp_split_to_array(lower(c.content), '\\s+'), lambda x: x <> '')) AS ca FROM hy JOIN chunks c USING (chunk_id) JOIN questions USING (query_id)),
s AS (SELECT query_id, chunk_id, round(sim + 0.25 * CASE WHEN len(qa) > 0 THEN len(list_intersect(qa, ca)) / len(qa)::DOUBLE ELSE 0 END + 0.05 * greatest(score, 0) + CASE WHEN chunk_id % 6 = 0 THEN 1.0 ELSE 0.0 END, 6) AS relevance FROM w)
SELECT query_id, chunk_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS place FROM s""",
)
def _(spark, sf):
    from docloom.functions.vectors import dot

    chunks, questions = _chunks(spark, sf), _questions(spark, sf)
    hits = S.hybrid_search(chunks, questions, 8).join(chunks.select("chunk_id", "content", "embedding"), "chunk_id").join(questions.withColumnRenamed("text", "query"), "query_id")
    candidates = hits.select("query_id", "chunk_id", "query", "content", "score", F.coalesce(dot(F.col("embedding"), F.col("vector")), F.lit(0.0)).alias("similarity"), (F.col("chunk_id") % 6 == 0).alias("prior"))
    return S.rank_tables(candidates).select("query_id", "chunk_id", "relevance", "place")


_BOXES = "SELECT l_suppkey AS q, l_orderkey * 10 + l_linenumber AS id, l_returnflag = 'R' AS intent, l_extendedprice AS score, l_partkey % 2 AS doc, l_linenumber % 2 AS page, l_quantity AS x0, 10.0 AS top, l_quantity + 20 AS x1, 30.0 + 1000 * l_tax AS bottom FROM lineitem"


@query(
    "f11_display_images",
    f"""WITH b AS ({_BOXES}), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY NOT intent, score DESC, id) AS i FROM b), f AS (SELECT * FROM o WHERE i = 1),
x AS (SELECT o.*, greatest(least(o.x1, f.x1) - greatest(o.x0, f.x0), 0) * greatest(least(o.bottom, f.bottom) - greatest(o.top, f.top), 0) AS common, (o.x1 - o.x0) * (o.bottom - o.top) + (f.x1 - f.x0) * (f.bottom - f.top) AS both_areas, o.doc = f.doc AND o.page = f.page AS same FROM o JOIN f USING (q) WHERE o.i > 1),
s AS (SELECT q, arg_min(id, i) AS id FROM x WHERE NOT (same AND common > 0.6 * (both_areas - common)) GROUP BY q)
SELECT q AS query_id, 0 AS place, id AS image_id FROM f UNION ALL SELECT q, 1, id FROM s""",
)
def _(spark, sf):
    x0 = F.col("l_quantity")
    images = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"), (F.col("l_returnflag") == "R").alias("intent"), F.col("l_extendedprice").alias("score"), (F.col("l_partkey") % 2).alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), x0.alias("x0"), F.lit(10.0).alias("top"), (x0 + 20).alias("x1"), (30.0 + 1000 * F.col("l_tax")).alias("bottom"))
    return S.display_images(images)


# --- where an answer comes from ---

_CUES = ["how many rows and the total", "what does the chairman say in the document", "compare revenue with the statement", "show the pdf figure", "plus the uploaded spreadsheet", "tell me a story", "average growth of segments", "top customer of"]
_ASKED = f"SELECT p_partkey AS k, {_CUES}[1 + p_partkey % 8] || ' ' || p_name || ' ' || CASE WHEN p_size % 5 = 0 THEN 'orders' ELSE lower(p_type) END AS query FROM part"


def _cued(spark, sf):
    cue = F.element_at(F.array(*map(F.lit, _CUES)), (1 + F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(cue, F.lit(" "), "p_name", F.lit(" "), F.when(F.col("p_size") % 5 == 0, "orders").otherwise(F.lower("p_type"))).alias("query"))


_WORD = "regexp_matches(query, '\\b(' || '{0}' || ')\\b')"
_HYBRID_ASK = f"(({_WORD.format('|'.join(P.METRIC_CUES))} OR {_WORD.format('|'.join(P.SECOND_CUES))} OR contains(query, 'compare')) AND {_WORD.format('|'.join(P.NARRATIVE_CUES))})"


@query("b13_sql_routing", f"WITH a AS ({_ASKED}) SELECT k, CASE WHEN {_HYBRID_ASK} THEN 'hybrid' WHEN {' OR '.join(f"contains(query, '{w}')" for w in P.DOCUMENT_WORDS)} THEN NULL WHEN {' OR '.join(f"contains(query, '{w}')" for w in P.AGGREGATE_WORDS)} THEN 'sql' WHEN regexp_matches(query, '\\b(orders|customer|lineitem)\\b') THEN 'sql' END AS route FROM a")
def _(spark, sf):
    return _cued(spark, sf).select("k", P.sql_route(F.col("query"), ["orders", "customer", "lineitem"]).alias("route"))


@query("b18_tool_gate", "SELECT event_id, CASE event_type WHEN 'click' THEN 'not a query' WHEN 'error' THEN 'forbidden keyword' WHEN 'signup' THEN 'system catalog' END AS reason, event_type NOT IN ('click', 'error', 'signup') AS allowed FROM events")
def _(spark, sf):
    kind, n = F.col("event_type"), F.col("user_id").cast("string")
    sql = F.when(kind == "click", F.concat(F.lit("SHOW TABLES "), n)).when(kind == "error", F.concat(F.lit("SELECT 1; -- x\n".replace(";", "")), F.lit(" WHERE 1 = (DROP TABLE t"), n, F.lit(")"))).when(kind == "signup", F.concat(F.lit("SELECT * FROM information_schema.t"), n)).otherwise(F.concat(F.lit("SELECT * FROM orders WHERE k = "), n))
    return P.tool_gate(table(spark, sf, "events").select("event_id", sql.alias("sql")), "sql").select("event_id", "reason", "allowed")


@query(
    "b22_stop_and_supplement",
    """WITH t AS (SELECT user_id, bool_or(event_type = 'click') AS docs, bool_or(event_type = 'purchase') AS db, bool_or(event_type = 'view') AS listed, max(value) > 50 AS docs_ok, min(value) < 20 AS db_ok, count(*) % 3 AS indexed FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN docs AND db THEN true WHEN docs THEN NOT db_ok WHEN db THEN NOT docs_ok OR indexed = 0 ELSE false END AS stop, db AND NOT docs AND docs_ok AND indexed > 0 AS search_too, docs AND NOT db AND db_ok AS query_too FROM t""",
)
def _(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "click", "search_documents").when(kind == "purchase", "query_database").when(kind == "view", "list_documents")
    turns = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(name).alias("tools"), (F.max("value") > 50).alias("docs_ok"), (F.min("value") < 20).alias("db_ok"), (F.count("*") % 3).alias("indexed"))
    tools, docs_ok, db_ok, indexed = F.col("tools"), F.col("docs_ok"), F.col("db_ok"), F.col("indexed")
    return turns.select("user_id", P.stop_after_tools(tools, db_ok, docs_ok, indexed).alias("stop"), P.needs_documents(tools, docs_ok, indexed).alias("search_too"), P.needs_database(tools, db_ok).alias("query_too"))


# --- registries, listings and summaries ---


@query("f13_sessions_by_user", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events")
def _(spark, sf):
    # Each user's sessions, the newest first; none is cut.
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


_RECORDS = "SELECT doc_id, lang AS user_id, 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.pdf' WHEN doc_id % 3 = 1 THEN '.xlsx' ELSE '' END AS filename, n_chars % 40 AS pages, CASE WHEN n_chars > 500 THEN 1 + n_chars // 400 ELSE 0 END AS chunks, CASE WHEN doc_id % 10 = 9 THEN 'failed' ELSE 'indexed' END AS status FROM documents"


def records(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    name = F.concat(F.lit("f"), d.cast("string"), F.when(d % 3 == 0, ".pdf").when(d % 3 == 1, ".xlsx").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("user_id"), name.alias("filename"), (n % 40).alias("pages"), F.when(n > 500, 1 + F.floor(n / 400)).otherwise(0).alias("chunks"), F.when(d % 10 == 9, "failed").otherwise("indexed").alias("status"))


@query("b09_indexed_records", f"SELECT user_id, count(*) AS n FROM ({_RECORDS}) WHERE status = 'indexed' AND chunks > 0 AND doc_id IN (SELECT doc_id FROM labels) GROUP BY user_id")
def _(spark, sf):
    from docloom.operators import library

    scope = table(spark, sf, "labels").select("doc_id")
    return library.indexed(records(spark, sf), scope).groupBy("user_id").agg(F.count("*").alias("n"))


@query("b07_scope_check", "WITH r AS (SELECT doc_id, lang AS user_id FROM documents), a AS (SELECT conv_id, turn AS i, (conv_id * 3 + turn) % 2500 AS doc_id, CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS user_id FROM conversations WHERE role = 'user') SELECT conv_id, count(*) - count(r.doc_id) AS missing, count(*) = count(r.doc_id) AS valid FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.user_id = r.user_id GROUP BY conv_id")
def _(spark, sf):
    from docloom.operators import library

    c = F.col("conv_id")
    asked = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", ((c * 3 + F.col("turn")) % 2500).alias("doc_id"), F.when(c % 3 == 0, "en").when(c % 3 == 1, "de").otherwise("fr").alias("user_id"))
    return library.validate_scopes(asked, records(spark, sf), "conv_id")


@query("b08_scope_formats", f"WITH r AS ({_RECORDS}), a AS (SELECT conv_id, (conv_id * 3 + turn * 3) % 200 AS doc_id FROM conversations) SELECT conv_id, bool_and(coalesce(filename LIKE '%.pdf', false)) AS pdf_only, bool_and(coalesce(filename LIKE '%.xlsx', false)) AS xlsx_only FROM a LEFT JOIN r USING (doc_id) GROUP BY conv_id")
def _(spark, sf):
    from docloom.operators import library

    asked = table(spark, sf, "conversations").select("conv_id", ((F.col("conv_id") * 3 + F.col("turn") * 3) % 200).alias("doc_id"))
    return library.scope_formats(asked, records(spark, sf), "conv_id")


@query(
    "f14_library_hint",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY doc_id) AS i FROM ({_RECORDS}) WHERE status = 'indexed' AND chunks > 0),
s AS (SELECT user_id, string_agg('- ' || filename || ' (' || CASE WHEN doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 3 = 1 THEN 'xlsx' ELSE 'file' END || ', ' || pages || ' pages, ' || chunks || ' chunks, indexed)', chr(10) ORDER BY i) FILTER (WHERE i <= 8) AS body, count(*) AS n FROM r GROUP BY user_id)
SELECT user_id, 'Indexed documents available (recent):' || chr(10) || body || CASE WHEN n > 8 THEN chr(10) || '(' || (n - 8) || ' more indexed documents in the library.)' ELSE '' END AS hint FROM s""",
)
def _(spark, sf):
    from docloom.operators import library

    return library.inventory(records(spark, sf), "user_id", "doc_id")


@query(
    "d02_digest",
    """WITH c AS (SELECT conv_id AS doc_id, turn, role AS chunk_type, 's' || (turn * 7 % 11) AS section FROM conversations),
f AS (SELECT doc_id, section, min(turn) AS o FROM c GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i FROM f), s AS (SELECT doc_id, string_agg('- ' || section, chr(10) ORDER BY i) AS sections FROM u WHERE i <= 8 GROUP BY doc_id),
k AS (SELECT doc_id, chunk_type, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT doc_id, string_agg(chunk_type || '=' || n, ', ' ORDER BY chunk_type) AS kinds FROM k GROUP BY doc_id), p AS (SELECT doc_id, max(turn) AS pages FROM c GROUP BY doc_id)
SELECT doc_id, 'File: f' || doc_id || '.pdf (pdf)' || CASE WHEN pages > 0 THEN chr(10) || 'Size: ' || pages || ' pages' ELSE '' END || chr(10) || 'Chunk types: ' || kinds || chr(10) || 'Sections:' || chr(10) || sections AS digest FROM p JOIN t USING (doc_id) JOIN s USING (doc_id)""",
)
def _(spark, sf):
    from docloom.operators import library

    t = F.col("turn")
    chunks = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("source_format"), t.alias("page_number"), F.lit(0).alias("block_index"), F.col("role").alias("chunk_type"), F.concat(F.lit("s"), (t * 7 % 11).cast("string")).alias("section"), F.lit(None).cast("string").alias("subsection"), F.lit(None).cast("string").alias("sheet_name"))
    return library.digests(chunks).select("doc_id", "digest")


@query("k02_status_updates", "WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'indexed' END AS status, CASE WHEN event_type IN ('view', 'click') THEN least(greatest(CAST(floor(value * 2) AS BIGINT), 0), 100) WHEN event_type = 'purchase' THEN 100 END AS progress FROM events) SELECT user_id, coalesce(arg_max(status, event_id) FILTER (WHERE status IS NOT NULL), 'pending') AS status, coalesce(arg_max(progress, event_id) FILTER (WHERE progress IS NOT NULL), 0) AS progress, count(*) AS updates FROM e GROUP BY user_id")
def _(spark, sf):
    from docloom.operators import library

    kind = F.col("event_type")
    status = F.when(kind == "view", "processing").when(kind == "error", "failed").when(kind == "purchase", "indexed")
    progress = F.when(kind.isin("view", "click"), F.floor(F.col("value") * 2)).when(kind == "purchase", F.lit(100).cast("long"))
    return library.document_states(table(spark, sf, "events").select("user_id", "event_id", status.alias("status"), progress.alias("progress")), "user_id", "event_id")


@query("e10_prior_tables", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, turn, back, i, 't' || ((turn + i) % 4) AS id FROM a, range(0, 3) r(i) WHERE back <= 3 AND (turn + i) % 3 <> 0), f AS (SELECT conv_id, id, min(back * 10 + i) AS o FROM s GROUP BY ALL) SELECT conv_id, string_agg(id, ',' ORDER BY o) AS ids FROM f GROUP BY conv_id")
def _(spark, sf):
    from docloom.operators import library

    replies = table(spark, sf, "conversations").filter("role = 'assistant'").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    kind = F.when((F.col("turn") + F.col("i")) % 3 == 0, "text").otherwise("table")
    sources = replies.select("conv_id", "turn", "i", kind.alias("chunk_type"), F.concat(F.lit("t"), ((F.col("turn") + F.col("i")) % 4).cast("string")).alias("chunk_id"))
    return library.prior_tables(sources, "conv_id", "turn", "i").select("conv_id", F.array_join("ids", ",").alias("ids"))


@query("d08_eligibility", "WITH e AS (SELECT user_id, event_id, value, CASE WHEN event_type = 'view' THEN 'not_a_table' WHEN value < 10 THEN 'not_chartable' WHEN event_type = 'error' THEN 'no_profile' ELSE 'eligible' END AS outcome FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'eligible') AS eligible, count(*) FILTER (WHERE outcome = 'not_a_table') AS not_a_table, count(*) FILTER (WHERE outcome = 'not_chartable') AS not_chartable, count(*) FILTER (WHERE outcome = 'no_profile') AS no_profile, round(max(value), 4) AS top_score FROM e GROUP BY user_id")
def _(spark, sf):
    from docloom.operators import library

    kind = F.when(F.col("event_type") == "view", "text").otherwise("table")
    hits = table(spark, sf, "events").select("user_id", F.col("event_id").alias("chunk_id"), kind.alias("chunk_type"), (F.col("value") >= 10).alias("chartable"), (F.col("event_type") != "error").alias("profiled"), F.col("value").alias("score"))
    return library.request_summary(hits, "user_id")


@query("h06_match_profiles")
def _(spark, sf):
    from docloom.operators.phrases import match_profiles

    return match_profiles(table(spark, sf, "benchmark").select("item_id", "text"), "item_id", "text")


@query("h04_anchor_merge")
def _(spark, sf):
    from docloom.operators.phrases import merge_anchor_phrases

    back = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = table(spark, sf, "conversations").withColumn("before", back)
    return asked.select("conv_id", "turn", merge_anchor_phrases(F.col("text"), F.array_compact(F.array("before"))).alias("query"))


@query(
    "a02_source_files",
    f"""WITH r AS ({_RECORDS}), f AS (SELECT doc_id, user_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['a.pdf', filename, 'viewer.pdf'] WHEN 1 THEN ['z.docx', 'b.xlsx', 'a.docx'] WHEN 2 THEN ['viewer.pdf', 'x.viewer.pdf'] ELSE ['q.xlsx', 'readme.txt'] END) AS name FROM r),
k AS (SELECT *, CASE WHEN name LIKE '%.pdf' THEN 0 WHEN name LIKE '%.docx' THEN 1 WHEN name LIKE '%.xlsx' THEN 2 END AS kind, 'up/' || user_id || '/' || doc_id || '/' || name AS path FROM f WHERE name NOT LIKE '%viewer.pdf')
SELECT r.user_id, r.doc_id, arg_min(k.path, (name <> filename, kind, k.path)) FILTER (WHERE kind IS NOT NULL) AS path FROM r LEFT JOIN k USING (doc_id) GROUP BY r.user_id, r.doc_id""",
)
def _(spark, sf):
    from docloom.operators import library

    known = records(spark, sf)
    d, text = F.col("doc_id"), lambda *xs: F.array(*[F.lit(x) for x in xs])
    names = F.when(d % 4 == 0, F.array(F.lit("a.pdf"), "filename", F.lit("viewer.pdf"))).when(d % 4 == 1, text("z.docx", "b.xlsx", "a.docx")).when(d % 4 == 2, text("viewer.pdf", "x.viewer.pdf")).otherwise(text("q.xlsx", "readme.txt"))
    files = known.select("user_id", "doc_id", F.explode(names).alias("name")).select("user_id", "doc_id", F.concat(F.lit("up/"), "user_id", F.lit("/"), d.cast("string"), F.lit("/"), "name").alias("path"))
    return library.source_files(known.select("user_id", "doc_id", "filename"), files)


@query("a30_talks", "WITH c AS (SELECT conv_id, turn, role, text FROM conversations), f AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS first, count(*) AS messages, count(*) FILTER (WHERE role = 'assistant') AS replies, max(turn) AS updated_at FROM c GROUP BY conv_id), t AS (SELECT *, trim(regexp_replace(first, '\\s+', ' ', 'g')) AS flat FROM f) SELECT conv_id, CASE WHEN flat = '' THEN 'New chat' WHEN length(flat) > 60 THEN rtrim(left(flat, 59)) || '…' ELSE flat END AS title, messages, replies, updated_at FROM t")
def _(spark, sf):
    from docloom.operators import library

    return library.talks(table(spark, sf, "conversations"), "conv_id", "turn", "turn")


@query("h11_mojibake", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    from docloom.functions.text import repair_mojibake

    # Texts as they look when their bytes are read as Latin-1.
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2(repair_mojibake(garbled), 256).alias("digest"))


@query("a23_table_inspection", "SELECT p_partkey, 3 AS row_count, p_size % 3 = 0 AS labels_lost, contains(lower(p_type), 'eco') OR contains(lower(p_brand), 'eco') AS metric_found FROM part")
def _(spark, sf):
    from docloom.functions.text import inspect_table, markdown_table

    label = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    row = F.array(label, F.col("p_type"), F.col("p_size").cast("string"))
    grid = F.array(F.array(F.lit("Brand"), F.lit("Kind"), F.lit("Size")), row, row)
    found = inspect_table(markdown_table(grid), F.lit("ECO"))
    return table(spark, sf, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.row_count", "x.labels_lost", "x.metric_found")
