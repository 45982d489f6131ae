"""Queries for relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.functions.text import token_overlap
from docloom.operators import charts as C
from docloom.operators import chunking, retrieval, sequences, sets, workbook
from docloom.plans.registry import query, table

# --- chunking, sinks, registries ---


@query(
    "e01_word_windows",
    """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, CAST(ceil(greatest(len(ws) - 400, 0) / 350.0) AS BIGINT) + 1)) AS ord FROM w WHERE len(ws) > 0)
SELECT doc_id, ord, sha256(array_to_string(ws[ord * 350 + 1 : ord * 350 + 400], ' ')) AS digest FROM s""",
)
def _(spark, sf):
    return chunking.chunk_documents(table(spark, sf, "documents")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.sha2("content", 256).alias("digest"))


@query(
    "a08_row_bands",
    """WITH n AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, c_custkey || ' | ' || c_name || ' | ' || c_mktsegment AS line FROM customer)
SELECT c_nationkey, (r - 1) // 30 AS band, min(r) AS first_row, max(r) AS last_row, sha256(string_agg(line, chr(10) ORDER BY r)) AS digest FROM n GROUP BY ALL""",
)
def _(spark, sf):
    bands = chunking.row_bands(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])
    return bands.select("c_nationkey", "band", "first_row", "last_row", F.sha2("content", 256).alias("digest"))


@query("a12_delete_cascade", "SELECT count(*) AS before, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) AS after FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    left = sets.delete_by_key(docs, table(spark, sf, "labels").filter("quality = 0"), "doc_id")
    return docs.agg(F.count("*").alias("before")).crossJoin(left.agg(F.count("*").alias("after")))


@query("a13_count_by_key", "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "a14_registry_upsert",
    "SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(least(greatest(value, 0), 100), event_id) FILTER (WHERE event_type <> 'view') AS progress, min(event_id) AS created FROM events GROUP BY user_id",
)
def _(spark, sf):
    clamped = F.when(F.col("event_type") != "view", F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0)))
    history = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("status"), clamped.alias("progress"))
    latest = sets.upsert_latest(history, "user_id", "event_id", ["status", "progress"])
    return latest.join(history.groupBy("user_id").agg(F.min("event_id").alias("created")), "user_id")


@query("a15_point_lookup", "SELECT doc_id, source, 0.0::DOUBLE AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    wanted = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    return table(spark, sf, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "source", F.lit(0.0).alias("score"))


@query("a16_sheet_metadata", "SELECT 'nation' AS sheet, count(*) AS n_rows, 3 AS n_cols FROM nation UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'part', count(*), 6 FROM part")
def _(spark, sf):
    out = None
    for name in ("nation", "orders", "part"):
        df = table(spark, sf, name)
        row = df.agg(F.lit(name).alias("sheet"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))
        out = row if out is None else out.unionByName(row)
    return out


@query("a28_event_sink", "SELECT conv_id, turn AS seq, CASE role WHEN 'user' THEN 'meta' WHEN 'assistant' THEN 'token' ELSE 'route' END AS event, length(text) AS size FROM conversations")
def _(spark, sf):
    kind = F.when(F.col("role") == "user", "meta").when(F.col("role") == "assistant", "token").otherwise("route")
    payload = F.to_json(F.struct("role", "text"))
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), kind.alias("event"), payload.alias("payload"))
    return rows.select("conv_id", "seq", "event", F.length(F.from_json("payload", "role string, text string")["text"]).alias("size"))


@query("a29_audit_log", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS attempts, count(*) FILTER (WHERE value > 50) AS allowed FROM events GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 50).alias("allowed"))


# --- filters and gates ---


@query("b01_post_filter", "WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) SELECT l_suppkey, r AS rank, l_orderkey, l_linenumber FROM t JOIN orders ON o_orderkey = l_orderkey WHERE r <= 10 AND o_orderstatus = 'F'")
def _(spark, sf):
    # The filter comes after the cut: fewer than k rows may stay.
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    top = table(spark, sf, "lineitem").withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return top.join(table(spark, sf, "orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "rank", "l_orderkey", "l_linenumber")


@query("b07_scope_validation", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, sf):
    owned = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id")
    return table(spark, sf, "labels").select("doc_id").join(owned, "doc_id", "left_anti")


@query("b08_all_of", "SELECT source, bool_and(lang = 'en') AS only_en, bool_or(lang = 'en') AS any_en FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.coalesce(F.bool_and(F.col("lang") == "en"), F.lit(False)).alias("only_en"), F.bool_or(F.col("lang") == "en").alias("any_en"))


@query("b09_indexed_documents", "SELECT lang, count(*) AS n FROM documents WHERE n_chars > 0 AND source IN ('src1', 'src2', 'src3') GROUP BY lang")
def _(spark, sf):
    return table(spark, sf, "documents").filter("n_chars > 0 and source in ('src1', 'src2', 'src3')").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "b20_table_acceptance",
    "SELECT o_custkey, CASE WHEN n < 2 THEN 'too few rows' WHEN dated < 0.9 * n THEN 'labels' WHEN kinds < 0.5 * n THEN 'headers' END AS reason FROM (SELECT o_custkey, count(*) AS n, count(o_orderdate) AS dated, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey)",
)
def _(spark, sf):
    each = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count("o_orderdate").alias("dated"), F.count_distinct("o_orderpriority").alias("kinds"))
    checks = [("too few rows", F.col("n") >= 2), ("labels", F.col("dated") >= 0.9 * F.col("n")), ("headers", F.col("kinds") >= 0.5 * F.col("n"))]
    return each.select("o_custkey", sets.first_failure(checks).alias("reason"))


@query("b19_expansion_gate", "SELECT conv_id, count(DISTINCT role) > 1 AND count(*) >= 4 AS skip FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(((F.count_distinct("role") > 1) & (F.count("*") >= 4)).alias("skip"))


# --- joins ---

_KEYS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("orders", "o_orderkey"), ("orders", "o_custkey")]
_CELLS = " UNION ".join(f"SELECT '{t}' AS sheet, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {t}" for t, c in _KEYS)
_OVERLAPS = f"WITH c AS ({_CELLS}), s AS (SELECT sheet, col, count(*) AS ndv FROM c GROUP BY ALL), m AS (SELECT a.sheet, a.col, b.sheet AS hub, b.col AS hub_col, count(*) AS k FROM c a JOIN c b ON a.value = b.value AND a.sheet <> b.sheet GROUP BY ALL), o AS (SELECT m.*, k / ndv::DOUBLE AS overlap FROM m JOIN s USING (sheet, col) WHERE k / ndv::DOUBLE >= 0.85)"


def _sheets(spark, sf):
    names: dict[str, list[str]] = {}
    for t, c in _KEYS:
        names.setdefault(t, []).append(c)
    return {t: table(spark, sf, t).select(*cols) for t, cols in names.items()}


@query("c01_join_discovery", _OVERLAPS + ", r AS (SELECT *, row_number() OVER (PARTITION BY sheet, hub ORDER BY overlap DESC, col, hub_col) AS i FROM o) SELECT sheet, col, hub, hub_col, round(overlap, 6) AS overlap, count(*) OVER (PARTITION BY hub) AS hub_degree FROM r WHERE i = 1")
def _(spark, sf):
    return workbook.best_joins(workbook.column_overlaps(_sheets(spark, sf))).withColumn("overlap", F.round("overlap", 6))


@query("c02_join_validation", "SELECT count(c_custkey) AS matched, count(*) AS total, round(count(c_custkey) / count(*)::DOUBLE, 6) AS overlap, CASE WHEN count(c_custkey) >= 0.9 * count(*) THEN 'accepted' WHEN count(c_custkey) >= 0.85 * count(*) THEN 'soft_link' ELSE 'overlap_below_threshold' END AS verdict, CASE WHEN 1 - count(DISTINCT o_custkey) / count(*)::DOUBLE > 0.01 THEN 'one_to_many' ELSE 'one_to_one' END AS cardinality FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    return workbook.validate_join(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey").withColumn("overlap", F.round("overlap", 6))


@query("c04_repeat_ratio", "SELECT o_orderpriority, round(1 - count(DISTINCT o_custkey) / count(*)::DOUBLE, 6) AS repeat FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(1 - F.count_distinct("o_custkey") / F.count("*"), 6).alias("repeat"))


@query("c05_enrich_one", "SELECT c_custkey, c_name, coalesce(o.p, '') AS last_priority FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def _(spark, sf):
    return workbook.enrich_one(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "last_priority")


@query("c06_enrich_many", "WITH r AS (SELECT o_custkey, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), s AS (SELECT o_custkey, string_agg(v, ', ' ORDER BY i) FILTER (WHERE i <= 3) || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ' more)' ELSE '' END AS t FROM r GROUP BY o_custkey) SELECT c_custkey, coalesce(t, '') AS priorities FROM customer LEFT JOIN s ON c_custkey = o_custkey")
def _(spark, sf):
    return workbook.enrich_many(table(spark, sf, "customer").select("c_custkey"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "priorities")


@query("c08_band_entity_keys", "SELECT o_orderkey // 30 AS band, array_to_string(list_sort(list(DISTINCT CAST(o_custkey AS VARCHAR))), ',') AS entity_keys, count(*) AS n_rows FROM orders GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumn("band", F.floor(F.col("o_orderkey") / 30))
    tagged = workbook.tag_bands(rows, ["band"], "o_custkey", "o_orderkey")
    return tagged.select("band", F.array_join("entity_keys", ",").alias("entity_keys"), F.size("row_keys").cast("long").alias("n_rows"))


@query("c10_anchor_expansion", "WITH s AS (SELECT o_custkey, max(o_totalprice) AS score FROM orders GROUP BY o_custkey), a AS (SELECT o_custkey FROM s ORDER BY score DESC, o_custkey LIMIT 3) SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN a USING (o_custkey)")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    # The three anchors are the feature; everything that belongs to them follows.
    anchors = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("score")).orderBy(F.desc("score"), "o_custkey").limit(3).select("o_custkey")
    owned = orders.join(F.broadcast(anchors), "o_custkey").select("o_orderkey", "o_custkey")
    return table(spark, sf, "lineitem").join(owned, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("c11_one_per_uncovered_sheet", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY c_nationkey")
def _(spark, sf):
    covered = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").join(covered, "c_nationkey", "left_anti").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@query("c12_key_overlap", "SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) GROUP BY o_custkey")
def _(spark, sf):
    keys = table(spark, sf, "supplier").filter("s_nationkey = 7").select(F.col("s_suppkey").alias("l_suppkey"))
    hits = table(spark, sf, "lineitem").join(keys, "l_suppkey", "left_semi")
    return hits.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("c15_block_range_join", "SELECT a.l_orderkey AS doc, a.l_linenumber AS image, b.l_linenumber AS block, 1 - abs(a.l_linenumber - b.l_linenumber) / 2.0::DOUBLE AS score FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 2 WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R' AND 1 - abs(a.l_linenumber - b.l_linenumber) / 2.0 >= 0.3")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    images = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("image"))
    texts = lines.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("block"))
    gap = F.abs(F.col("image") - F.col("block"))
    return images.join(texts, "doc").filter(gap <= 2).withColumn("score", 1 - gap / 2.0).filter("score >= 0.3")


@query("c18_lookup_join", "SELECT l_suppkey, s_name, n_name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return counts.join(named, F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", "s_name", "n_name", "n")


@query("c19_source_merge", "SELECT coalesce(a.k, b.k) AS custkey, a.n AS early, b.n AS late FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) b ON a.k = b.k")
def _(spark, sf):
    def side(p, name):
        return table(spark, sf, "orders").filter(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias(name))

    return side("1-URGENT", "early").join(side("5-LOW", "late"), "custkey", "full_outer")


# --- aggregates ---


@query("d01_type_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS other FROM events GROUP BY user_id")
def _(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("click"), F.count_if(kind == "view").alias("view"), F.count_if(~kind.isin("click", "view")).alias("other"))


@query("d02_document_digest", "WITH s AS (SELECT source, lang, min(doc_id) AS o, count(*) AS n FROM documents GROUP BY source, lang) SELECT source, string_agg(lang || ':' || n, ', ' ORDER BY o) AS langs, sum(n)::BIGINT AS n FROM s GROUP BY source")
def _(spark, sf):
    each = table(spark, sf, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("o"), F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o", "lang", "n"))), lambda x: F.concat(x["lang"], F.lit(":"), x["n"].cast("string")))
    return each.groupBy("source").agg(F.array_join(parts, ", ").alias("langs"), F.sum("n").alias("n"))


@query("d03_ordered_unique", "WITH f AS (SELECT user_id, lower(event_type) AS k, arg_min(event_type, event_id) AS event_type, min(event_id) AS o FROM events GROUP BY user_id, lower(event_type)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS place FROM f) SELECT user_id, event_type, place FROM r WHERE place <= 3")
def _(spark, sf):
    return sets.ordered_unique(table(spark, sf, "events"), "user_id", "event_type", "event_id", 3)


@query("d04_mode_or_default", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT user_id, arg_max(event_type, (n, event_type)) AS t, max(n) AS top, sum(n) AS total, count(*) AS kinds FROM c GROUP BY user_id) SELECT user_id, CASE WHEN kinds > 1 AND top < greatest(2, total // 2) THEN 'Value' ELSE t END AS event_type FROM e")
def _(spark, sf):
    return sets.mode_or_default(table(spark, sf, "events"), "user_id", "event_type", "Value")


@query("d05_magnitude_spread", "SELECT o_custkey, round(max(abs(o_totalprice)) / min(abs(o_totalprice)), 6) AS spread, list_sort(list(round(o_totalprice, 2)))[count(*) // 2 + 1] AS upper_median FROM orders WHERE o_totalprice <> 0 GROUP BY o_custkey")
def _(spark, sf):
    each = table(spark, sf, "orders").filter("o_totalprice <> 0").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return each.select("o_custkey", F.round(C.spread(F.col("v")), 6).alias("spread"), C.upper_median(F.transform("v", lambda x: F.round(x, 2))).alias("upper_median"))


@query("d06_ratio", "SELECT l_suppkey, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("share"))


@query("d10_median", "SELECT l_suppkey, median(l_quantity) AS mid, quantile_cont(l_extendedprice, 0.5) >= 1.8 * 20000 AS tall FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("mid"), (F.median("l_extendedprice") >= 1.8 * 20000).alias("tall"))


@query("d11_gutter_histogram", "WITH n AS (SELECT l_suppkey AS page, least(CAST(floor(l_extendedprice / 120000 * 30) AS BIGINT), 29) AS bin, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT p.page, b AS bin, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT l_suppkey AS page FROM lineitem) p CROSS JOIN range(0, 30) t(b) LEFT JOIN n ON n.page = p.page AND n.bin = b) SELECT page, bin, n, round(avg(n) OVER (PARTITION BY page ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM f")
def _(spark, sf):
    words = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "page")
    return sequences.gutter_histogram(words, "page", F.col("l_extendedprice"), 120000.0).withColumn("smooth", F.round("smooth", 6))


@query("d13_hub_degree", "SELECT n_name, s_name, count(*) OVER (PARTITION BY n_nationkey) AS degree FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("n_name", "s_name", F.count("*").over(Window.partitionBy("n_nationkey")).alias("degree"))


@query("d14_lexical_overlap", "WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part) SELECT p_partkey, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, w)) / len(q)::DOUBLE, 6) ELSE 0.0 END AS overlap FROM t")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(token_overlap(F.col("p_type"), F.col("p_name")), 6).alias("overlap"))


# --- windows ---


@query("e03_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return sequences.forward_fill(rows, "user_id", "event_id", "last_purchase").select("event_id", "last_purchase")


@query("e04_first_header_row", "SELECT l_orderkey, min(CASE WHEN l_discount > 0.05 THEN l_linenumber END) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    return sequences.first_row_where(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_discount") > 0.05)


@query("e05_best_per_sheet", "SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def _(spark, sf):
    return retrieval.best_per(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("e06_relative_gate", "WITH f AS (SELECT user_id, event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS anchor FROM f WHERE value >= 0.7 * a) SELECT user_id, event_id, anchor FROM k WHERE anchor <= 3")
def _(spark, sf):
    hits = table(spark, sf, "events").withColumnRenamed("value", "score")
    return retrieval.relative_gate(hits, 0.7, 3, "user_id", ["event_id"]).select("user_id", "event_id", "anchor")


@query("e07_promotion_gate", "SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) WHERE event_type = 'view' AND top > 0 AND value >= 0.6 * top")
def _(spark, sf):
    hits = table(spark, sf, "events").withColumnRenamed("value", "score")
    return retrieval.promotion_gate(hits, 0.6, "user_id", F.col("event_type") == "view").select("user_id", "event_id")


@query("e08_last_queries", "SELECT conv_id, turn, back, left(text, 400) AS q FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user') WHERE back <= 6")
def _(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    return sequences.last_n(asked, "conv_id", "turn", 6).select("conv_id", "turn", "back", F.substring("text", 1, 400).alias("q"))


@query("e09_latest_reply", "SELECT conv_id, left(arg_max(text, turn) FILTER (WHERE role = 'assistant'), 800) AS reply FROM conversations GROUP BY conv_id")
def _(spark, sf):
    reply = F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.substring(reply, 1, 800).alias("reply"))


@query("e14_gap_clusters", "WITH g AS (SELECT l_suppkey, l_extendedprice AS x, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) > 500 THEN 1 ELSE 0 END AS s FROM lineitem), c AS (SELECT *, CAST(sum(s) OVER (PARTITION BY l_suppkey ORDER BY x RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g) SELECT l_suppkey, cluster, min(x) AS lo, max(x) AS hi, count(*) AS n FROM c GROUP BY ALL")
def _(spark, sf):
    return sequences.gap_clusters(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 500.0).drop("mean")


@query("e15_reading_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity > 25, round(l_tax, 1), l_extendedprice, l_linenumber) AS place FROM lineitem")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity") > 25, F.round("l_tax", 1), "l_extendedprice", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("e17_highlight_range", "SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE l_discount = top AND top >= 0.034 GROUP BY l_orderkey")
def _(spark, sf):
    top = F.max("l_discount").over(Window.partitionBy("l_orderkey"))
    rows = table(spark, sf, "lineitem").withColumn("top", top).filter("l_discount = top and top >= 0.034")
    return rows.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))


# --- ranking ---


@query("f03_table_slots", "WITH h AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'text' END AS chunk_type, l_extendedprice AS score FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_type ORDER BY score DESC, chunk_id) AS r, least(count(*) FILTER (WHERE chunk_type = 'table') OVER (PARTITION BY query_id), 2) AS t FROM h), k AS (SELECT * FROM r WHERE CASE WHEN chunk_type = 'table' THEN r <= 2 ELSE r <= 6 - t END) SELECT query_id, chunk_id, chunk_type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k")
def _(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "table").otherwise("text")
    hits = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), kind.alias("chunk_type"), F.col("l_extendedprice").alias("score"))
    return retrieval.reserve_table_slots(hits, 6, 2).select("query_id", "chunk_id", "chunk_type", "rank")


@query("f04_diverse_cap", "WITH b AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS s FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderpriority) AS place FROM b) SELECT o_custkey, o_orderpriority, place FROM r WHERE place <= 3")
def _(spark, sf):
    best = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("s"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("s"), "o_orderpriority")
    return best.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("o_custkey", "o_orderpriority", "place")


@query(
    "f05_greedy_budget",
    """WITH RECURSIVE h AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, turn) AS i FROM h),
g AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, false AS kept, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS size FROM h
  UNION ALL SELECT r.conv_id, r.i, CASE WHEN used + r.size <= 1500 THEN used + r.size ELSE used END, used + r.size <= 1500, r.turn, r.size FROM g JOIN r ON r.conv_id = g.conv_id AND r.i = g.i + 1),
a AS (SELECT conv_id, bool_or(kept) AS found_any FROM g GROUP BY conv_id)
SELECT g.conv_id, turn, size FROM g JOIN a USING (conv_id) WHERE i > 0 AND (kept OR NOT found_any)""",
)
def _(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("_o"), "turn", "size")))
    kept = rows.groupBy("conv_id").agg(items.alias("items")).select("conv_id", F.explode(retrieval.greedy_budget(F.col("items"), None, 1500)).alias("x"))
    return kept.select("conv_id", "x.turn", "x.size")


@query("f07_candidate_ranking", "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / 1000.0 + 0.25 * p_size + CASE WHEN p_type LIKE '%STEEL%' THEN 1.0 ELSE 0.0 END DESC, p_partkey) AS place FROM part")
def _(spark, sf):
    score = F.col("p_retailprice") / 1000.0 + 0.25 * F.col("p_size") + F.when(F.col("p_type").contains("STEEL"), 1.0).otherwise(0.0)
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy(score.desc(), "p_partkey")).alias("place"))


@query("f08_argmax_row", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id FROM events WHERE value > 0 GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").filter("value > 0").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("f13_session_listing", "SELECT user_id, event_type, max(ts) AS updated_at, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS place FROM events GROUP BY user_id, event_type")
def _(spark, sf):
    # All sessions of each user (one a kind of event), the last used first.
    newest = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("updated_at"))
    return newest.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "event_type")))


@query("f14_inventory", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT source, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY i) FILTER (WHERE i <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS hint FROM r GROUP BY source")
def _(spark, sf):
    ranked = table(spark, sf, "documents").withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.struct("i", "doc_id")))), lambda x: x["doc_id"].cast("string")), ", ")
    more = F.when(F.count("*") > 5, F.concat(F.lit(" and "), (F.count("*") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return ranked.groupBy("source").agg(F.concat(head, more).alias("hint"))


# --- unions by key ---


@query("g01_keep_first", "SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    return sets.keep_first(table(spark, sf, "events"), "user_id", ["event_id"]).select("user_id", "event_type", "event_id")


@query("g02_keep_best", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return sets.keep_best(table(spark, sf, "events"), "user_id", "value", ["event_id"]).select("user_id", "event_id", "value")


@query("g03_keep_last", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seen FROM events GROUP BY user_id")
def _(spark, sf):
    return sets.keep_last(table(spark, sf, "events"), "user_id", ["event_id"]).select("user_id", "event_id", "event_type", F.col("first_seen.event_id").alias("first_seen"))


@query("g05_token_difference", "SELECT p_partkey, len(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda x: NOT list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), x))) AS fresh FROM part")
def _(spark, sf):
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_except(tokens("p_name"), tokens("p_type"))).cast("long").alias("fresh"))


@query("g07_statement_dedupe", "SELECT lower(trim(regexp_replace(event_type || '  ' || user_id % 50, '\\s+', ' ', 'g'))) AS k, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    text = F.concat("event_type", F.lit("  "), (F.col("user_id") % 50).cast("string"))
    k = F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


# --- search ---

_Q = "SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0"


@query("j03_nearest_neighbours", f"WITH q AS ({_Q}), d AS (SELECT query_id, vec_id, round(list_distance(embedding::DOUBLE[], query::DOUBLE[]), 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding::DOUBLE[], query::DOUBLE[]), vec_id) AS rank FROM embeddings, q) SELECT * FROM d WHERE rank <= 10")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.nearest(e, queries, 10).withColumn("distance", F.round("distance", 6))


@query("j03_approximate_neighbours")
def _(spark, sf):
    from docloom.operators import vector_index

    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search_index(vector_index.build_index(e), queries, 10).withColumn("distance", F.round("distance", 6))


_BM25 = """WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM benchmark),
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
s AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))) AS score FROM p JOIN q USING (term) JOIN df USING (term) JOIN t USING (doc_id), a GROUP BY query_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 6"""


@query("f01_bm25_top_k", _BM25)
def bm25_top_k(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(retrieval.index_words(F.col("text")))).alias("term"))
    return retrieval.bm25_top_k(table(spark, sf, "documents"), terms, 6, "doc_id", "text").select("query_id", "doc_id", "score", "rank")


@query("j04_hybrid_fusion", "WITH a AS (SELECT o_custkey AS query_id, o_orderpriority AS k, sum(o_totalprice) AS score FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS query_id, o_orderpriority AS k, count(*)::DOUBLE AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), x AS (SELECT query_id, k, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM a WINDOW w AS (PARTITION BY query_id)), y AS (SELECT query_id, k, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM b WINDOW w AS (PARTITION BY query_id)) SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.k, y.k) AS k, round(0.5 * coalesce(x.s, 0) + 0.5 * coalesce(y.s, 0), 6) AS score FROM x FULL OUTER JOIN y ON x.query_id = y.query_id AND x.k = y.k")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("k"), "o_totalprice", "o_orderstatus")
    a = orders.groupBy("query_id", "k").agg(F.sum("o_totalprice").alias("score"))
    b = orders.filter("o_orderstatus = 'F'").groupBy("query_id", "k").agg(F.count("*").cast("double").alias("score"))
    return retrieval.fuse(a, b, "k").withColumn("score", F.round("score", 6))


# --- charts ---

_GRID = "SELECT c_nationkey AS table_id, o_orderpriority AS name, year(o_orderdate) AS y, CAST(round(sum(o_totalprice)) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def grids(spark, sf):
    """A table for each nation: priorities by year, with a share column, as cells of text."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = rows.groupBy(F.col("c_nationkey").alias("table_id"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("v"))
    years = sums.groupBy("table_id").agg(F.array_sort(F.collect_set("y")).alias("years"))
    lines = sums.groupBy("table_id", "name").agg(F.map_from_entries(F.collect_list(F.struct("y", "v"))).alias("m")).join(years, "table_id")
    cell = lambda y: F.coalesce(F.format_number(F.try_element_at("m", y), 0), F.lit(""))
    body = lines.select("table_id", "years", "name", F.concat(F.array("name"), F.transform("years", cell), F.array(F.lit("10%"))).alias("r"))
    packed = body.groupBy("table_id").agg(F.first("years").alias("years"), F.array_sort(F.collect_list(F.struct("name", "r"))).alias("rows"))
    header = F.concat(F.array(F.lit("Metric")), F.transform("years", lambda y: F.concat(F.lit("(CNY Million) "), y.cast("string"))), F.array(F.lit("YoY")))
    return packed.select("table_id", F.concat(F.array(header), F.transform("rows", lambda x: x["r"])).alias("grid"))


@query("l01_wide_layout", f"WITH g AS ({_GRID}) SELECT table_id, count(DISTINCT y) AS periods FROM g GROUP BY table_id HAVING count(DISTINCT y) >= 2")
def _(spark, sf):
    return C.wide_layouts(C.column_roles(C.cells(grids(spark, sf))))


@query("l03_wide_series", f"WITH g AS ({_GRID}), t AS (SELECT table_id, count(DISTINCT y) AS k FROM g GROUP BY table_id) SELECT table_id, name, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS periods, CAST(sum(v) AS DOUBLE) AS total FROM g JOIN t USING (table_id) GROUP BY table_id, name, k HAVING count(*) = k")
def wide_series(spark, sf):
    cells = C.cells(grids(spark, sf))
    series = C.wide_series(cells, C.column_roles(cells))
    return series.select("table_id", "name", F.array_join("periods", ",").alias("periods"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("l04_long_series", "WITH p AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS revenue, count(*)::DOUBLE AS orders FROM orders GROUP BY 1) SELECT 'revenue' AS metric, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS periods, round(max(revenue), 2) AS top FROM p UNION ALL SELECT 'orders', string_agg(CAST(y AS VARCHAR), ',' ORDER BY y), max(orders) FROM p")
def _(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("revenue"), F.count("*").cast("double").alias("orders"))
    series = C.long_series(rows, "y", ["revenue", "orders"])
    return series.select("metric", F.array_join(F.transform("periods", lambda y: y.cast("string")), ",").alias("periods"), F.round(F.array_max("values"), 2).alias("top"))


@query("j14_chart_spec", f"WITH g AS ({_GRID}), t AS (SELECT table_id, count(DISTINCT y) AS k, count(DISTINCT name) AS s FROM g GROUP BY table_id), f AS (SELECT table_id, name FROM g JOIN t USING (table_id) GROUP BY table_id, name, k HAVING count(*) = k) SELECT table_id, CASE WHEN count(*) = 1 AND k >= 3 THEN 'line' ELSE 'bar' END AS kind, NULL::VARCHAR AS error, count(*) AS n_series FROM f JOIN t USING (table_id) GROUP BY table_id, k")
def _(spark, sf):
    cells = C.cells(grids(spark, sf))
    series = C.wide_series(cells, C.column_roles(cells))
    spec = series.groupBy("table_id").agg(F.first("periods").alias("labels"), F.array_sort(F.collect_list(F.struct("name", "values"))).alias("series"))
    kind = C.chart_type(F.size("series"), F.size("labels"))
    return spec.select("table_id", kind.alias("kind"), C.spec_error(kind, F.col("labels"), F.col("series")).alias("error"), F.size("series").cast("long").alias("n_series"))


@query("f10_period_slice", f"WITH g AS ({_GRID}), r AS (SELECT table_id, name, y, v, row_number() OVER (PARTITION BY table_id, name ORDER BY y) AS i FROM g) SELECT table_id, name, CAST(sum(v) AS BIGINT) AS v FROM r WHERE i <= 3 GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = rows.groupBy(F.col("c_nationkey").alias("table_id"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("v"))
    ranked = sums.withColumn("i", F.row_number().over(Window.partitionBy("table_id", "name").orderBy("y")))
    return ranked.filter("i <= 3").groupBy("table_id", "name").agg(F.sum("v").alias("v"))


@query("l07_entity_metrics", "SELECT c_custkey, metric, round(value, 2) AS value FROM (SELECT c_custkey, c_acctbal, coalesce(sum(o_totalprice), 0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) UNPIVOT (value FOR metric IN (c_acctbal, spent))")
def _(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("spent"))
    return rows.unpivot(["c_custkey"], ["c_acctbal", "spent"], "metric", "value").withColumn("value", F.round("value", 2))


@query("l08_pie_profile", "WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, count(*) AS slices, count(*) BETWEEN 2 AND 12 AND bool_and(n >= 0) AND sum(n) > 0 AS pie FROM s GROUP BY c_nationkey")
def _(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    pie = F.count("*").between(2, 12) & F.bool_and(F.col("n") >= 0) & (F.sum("n") > 0)
    return counts.groupBy("c_nationkey").agg(F.count("*").alias("slices"), pie.alias("pie"))
