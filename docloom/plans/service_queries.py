"""Queries for composed operations and what remains of the functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import numeric as N
from docloom.functions import policy as P
from docloom.operators import charts, retrieval, service, workbook
from docloom.operators.guarded_sql import run_sql
from docloom.plans.registry import query, table
from docloom.plans.relational_queries import _BM25


@query("u02_guarded_sql", "SELECT n_name, o_orderpriority, count(*) AS n, sum(count(*)) OVER (PARTITION BY n_name) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority")
def _(spark, sf):
    views = {t: table(spark, sf, t) for t in ("orders", "customer", "nation")}
    return run_sql(spark, "SELECT n_name, o_orderpriority, count(*) AS n, sum(count(*)) OVER (PARTITION BY n_name) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority", views)


@query("u02_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, GROUPING(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, sf):
    return run_sql(spark, "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", {"lineitem": table(spark, sf, "lineitem")})


@query("u06_active_connection", "WITH c AS (SELECT user_id, event_id, event_type FROM events), p AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'signup') AS chosen, min(event_id) AS first FROM c GROUP BY user_id) SELECT event_id, event_id = coalesce(chosen, first) AS is_active FROM c JOIN p USING (user_id)")
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    chosen = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return service.activate(events, "user_id", "event_id", chosen).select("event_id", "is_active")


@query("i09_active_tokens", "SELECT event_id, ts + INTERVAL 7 DAY AS expires FROM events WHERE ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    now = events.agg(F.max("ts").alias("now"))
    return service.active_tokens(events.crossJoin(F.broadcast(now)), "ts", F.col("now")).select("event_id", "expires")


_BYTE = "(16 * (instr('0123456789abcdef', substr(md5(w), {0}, 1)) - 1) + instr('0123456789abcdef', substr(md5(w), {1}, 1)) - 1)"


@query(
    "u05_hash_embedding",
    f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM documents),
n AS (SELECT doc_id, CAST({_BYTE.format(1, 2)} % 64 AS INT) AS place, sum(CASE WHEN {_BYTE.format(3, 4)} < 128 THEN 1 ELSE -1 END) AS n FROM t GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM n GROUP BY doc_id)
SELECT doc_id, place, round(CAST(CAST(n / length AS FLOAT) AS DOUBLE), 4) AS value FROM n JOIN l USING (doc_id) WHERE n <> 0""",
)
def _(spark, sf):
    vectors = service.hash_embed(table(spark, sf, "documents"), "doc_id", "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "v")).filter("v <> 0").select("doc_id", "place", F.round(F.col("v").cast("double"), 4).alias("value"))


@query(
    "j06_search_pipeline",
    _BM25[: _BM25.index("r AS (")]
    + """h AS (SELECT query_id, s.doc_id AS chunk_id, round(score, 4) AS score, CASE WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS chunk_type FROM s JOIN documents d ON d.doc_id = s.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_type ORDER BY score DESC, chunk_id) AS r, least(count(*) FILTER (WHERE chunk_type = 'table') OVER (PARTITION BY query_id), 2) AS t FROM h),
k AS (SELECT * FROM r WHERE CASE WHEN chunk_type = 'table' THEN r <= 2 ELSE r <= 6 - t END)
SELECT query_id, chunk_id, chunk_type, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k""",
)
def search_pipeline(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.when(F.col("text").contains(" | "), "table").otherwise("text").alias("chunk_type"))
    words = F.array_distinct(retrieval.index_words(F.col("text")))
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("term"))
    return service.search_documents(docs, terms).select("query_id", "chunk_id", "chunk_type", "score", "rank")


@query("f06_context", "SELECT conv_id, string_agg('[' || i || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id")
def _(spark, sf):
    return service.context_blocks(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("b05_source_rows", "WITH f AS (SELECT doc_id, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(left(t, 239)) || '…' ELSE t END AS snippet, lang <> 'xlsx' AS has_box FROM f")
def _(spark, sf):
    return service.source_rows(table(spark, sf, "documents"), "text", "lang").select("doc_id", "snippet", "has_box")


@query("b11_source_intent", "WITH q AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'only from the pdf please' WHEN 'view' THEN 'look in the database' WHEN 'error' THEN 'in the docs or in the db' ELSE event_type END AS t FROM events) SELECT event_id, CASE WHEN contains(t, 'pdf') THEN 'docs_only' WHEN contains(t, 'database') THEN 'db_only' END AS intent FROM q")
def _(spark, sf):
    kind = F.col("event_type")
    asked = F.when(kind == "click", "only from the pdf please").when(kind == "view", "look in the database").when(kind == "error", "in the docs or in the db").otherwise(kind)
    return table(spark, sf, "events").select("event_id", P.source_intent(asked).alias("intent"))


@query("b12_chart_requested", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{m}')" for m in P.CHART_MARKERS) + " AS chart FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.chart_requested(F.col("text")).alias("chart"))


#: What is said, in turn: before the words of a conversation, or alone.
_SAID = ["Hello!", "hey there", "Thank you.", "Do you mean", "what can you DO", "Which file do you mean?", "ok", "Please specify:", "how can you help with", "  "]
_IN = lambda phrases: "(" + " OR ".join(f"contains(s, '{p}')" for p in phrases) + ")"


@query(
    "b12_talk",
    f"""WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ([{', '.join(repr(x) for x in _SAID)}])[1 + (conv_id + turn) % {len(_SAID)}] ELSE ([{', '.join(repr(x) for x in _SAID)}])[1 + (conv_id + turn) % {len(_SAID)}] || ' ' || text || ' ?' END AS t FROM conversations),
n AS (SELECT *, regexp_replace(lower(trim(t)), '[?!.]+$', '') AS n, lower(trim(t)) AS s FROM q)
SELECT conv_id, turn, n = '' OR n IN ({', '.join(repr(x) for x in P.GREETINGS)}) OR (({' OR '.join(f"starts_with(n, '{p}')" for p in P.OPENINGS)}) AND length(n) < 40) OR {_IN(P.META_QUESTIONS).replace("contains(s", "contains(n")} AS small_talk,
  contains(s, '?') AND {_IN(P.CLARIFYING)} AND NOT {_IN(P.SCOPE_QUESTIONS)} AS clarification FROM n""",
)
def _(spark, sf):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (1 + (F.col("conv_id") + F.col("turn")) % len(_SAID)).cast("int"))
    text = F.when(F.col("turn") % 2 == 0, said).otherwise(F.concat(said, F.lit(" "), "text", F.lit(" ?")))
    return table(spark, sf, "conversations").select("conv_id", "turn", P.small_talk(text).alias("small_talk"), P.clarification(text).alias("clarification"))


@query("f02_top_k_policy", "SELECT doc_id, CASE WHEN lang = 'de' THEN 5 WHEN lang = 'fr' THEN 6 ELSE least(greatest(n_chars % 100, 1), 50) END AS k FROM documents")
def _(spark, sf):
    kind = F.when(F.col("lang") == "de", "xlsx").when(F.col("lang") == "fr", "pdf").otherwise("docx")
    return table(spark, sf, "documents").select("doc_id", P.search_top_k(kind, F.lit("hello"), F.col("n_chars") % 100).cast("long").alias("k"))


@query("j13_fenced_json", "SELECT event_id, user_id AS k FROM events")
def _(spark, sf):
    fenced = F.concat(F.lit("Sure:\n```json\n{\"k\": "), F.col("user_id").cast("string"), F.lit("}\n```"))
    return table(spark, sf, "events").select("event_id", F.from_json(P.strip_fences(fenced), "k long")["k"].alias("k"))


@query("j13_props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("j15_nested_tool_calls", "SELECT doc_id, 'search' AS name, doc_id % 9 AS k, coalesce(text, '') AS said, '{' || lang AS lang FROM documents WHERE NOT contains(coalesce(text, ''), '<')")
def _(spark, sf):
    """A document's whole text as an argument, with an object inside the arguments and a mark without any."""
    inner = F.to_json(F.struct(F.col("text").alias("q"), F.struct(F.concat(F.lit("{"), F.col("lang")).alias("lang")).alias("filter"), (F.col("doc_id") % 9).alias("k")))
    said = F.concat(F.lit("I call <function=none></function> then <function= search "), inner, F.lit("}></function>"))
    calls = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))).filter("instr(text, '<') = 0").select("doc_id", F.explode(P.tool_calls(said)).alias("c"))
    told = F.from_json("c.arguments", "q string, filter struct<lang:string>, k long")
    return calls.select("doc_id", F.col("c.name").alias("name"), told.alias("t")).select("doc_id", "name", "t.k", F.col("t.q").alias("said"), "t.filter.lang")


@query("j15_tool_calls", "SELECT event_id, 'search' AS name, user_id AS k FROM events")
def _(spark, sf):
    text = F.concat(F.lit("x <function=search{\"k\": "), F.col("user_id").cast("string"), F.lit("}></function>"))
    calls = table(spark, sf, "events").select("event_id", F.explode(P.tool_calls(text)).alias("c"))
    return calls.select("event_id", F.col("c.name").alias("name"), F.from_json("c.arguments", "k long")["k"].alias("k"))


@query("h14_answer_cleanup", "SELECT event_id, 'Found ' || user_id || '.' AS answer FROM events")
def _(spark, sf):
    raw = F.concat(F.lit("SELECT * FROM t\nFound "), F.col("user_id").cast("string"), F.lit(".\n```sql\nSELECT 1\n```"))
    return table(spark, sf, "events").select("event_id", P.clean_sql_answer(raw).alias("answer"))


@query("h16_rewrite_guard", "SELECT conv_id, turn, length(text) > 60 + 50 AND length(text) > 1.75 * 60 AS over FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", P.over_expanded(F.lpad(F.lit("q"), 60, "q"), F.col("text")).alias("over"))


@query("c09_name_links", "SELECT 'orders' AS sheet, 'o_custkey' AS header, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def _(spark, sf):
    # A standalone sheet whose header, its prefix aside, is a cluster's key.
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    header = next(c for c in orders.columns if any(c.split("_")[1].lower() == k.split("_")[1].lower() for k in customer.columns[:1]))
    linked = orders.join(customer, orders[header] == customer[customer.columns[0]], "left_semi")
    return linked.agg(F.lit("orders").alias("sheet"), F.lit(header).alias("header"), F.count("*").alias("n"))


@query("c03_overlap_ratio", "SELECT l_returnflag, round(avg(CASE WHEN o_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def _(spark, sf):
    known = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").distinct()
    rows = table(spark, sf, "lineitem").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy("l_returnflag").agg(F.round(F.avg(F.col("o_orderkey").isNotNull().cast("double")), 6).alias("overlap"))


@query("c07_enriched_chunks", "SELECT c_nationkey, count(*) AS n_rows, sum(CASE WHEN o.p IS NULL THEN 0 ELSE 1 END)::BIGINT AS enriched FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey GROUP BY c_nationkey")
def _(spark, sf):
    rich = workbook.enrich_one(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "last_priority")
    return rich.groupBy("c_nationkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("last_priority") != "").alias("enriched"))


@query("d08_request_summary", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 10) AS chartable, max(event_type) AS last_kind, list_sort(list(DISTINCT event_type))::VARCHAR AS kinds FROM events GROUP BY user_id")
def _(spark, sf):
    kinds = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("event_type")), ", "), F.lit("]"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("chartable"), F.max("event_type").alias("last_kind"), kinds.alias("kinds"))


@query("e10_recent_ids", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'assistant') SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM a WHERE back <= 3 GROUP BY conv_id")
def _(spark, sf):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    recent = table(spark, sf, "conversations").filter("role = 'assistant'").withColumn("back", back).filter("back <= 3")
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")), ",").alias("turns"))


@query("g06_total_rows", "SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1 HAVING lower(c_mktsegment) <> 'total'")
def _(spark, sf):
    sums = table(spark, sf, "customer").rollup("c_mktsegment").agg(F.count("*").alias("n"))
    return sums.select(F.coalesce("c_mktsegment", F.lit("Total")).alias("name"), "n").filter(F.lower("name") != "total")


@query("i05_annotation_column", "SELECT o_custkey, bool_and(o_orderpriority LIKE '%-%') AS dashed, count(*) FILTER (WHERE o_totalprice > 100000) >= 0.75 * count(*) AS mostly FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderpriority").contains("-")).alias("dashed"), (F.count_if(F.col("o_totalprice") > 100000) >= 0.75 * F.count("*")).alias("mostly"))


@query("f09_metric_columns", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'p_size' ELSE 'p_retailprice' END AS metric FROM part")
def _(spark, sf):
    columns = F.array(F.struct(F.when(F.col("p_size") > 25, -1).otherwise(0).alias("o"), F.lit("p_size").alias("c")), F.struct(F.when(F.col("p_size") > 25, 0).otherwise(-1).alias("o"), F.lit("p_retailprice").alias("c")))
    return table(spark, sf, "part").select("p_partkey", F.element_at(F.array_sort(columns), 1)["c"].alias("metric"))


@query("a10_slim_rows", "SELECT p_partkey, p_name AS a, p_brand AS b, '' AS c FROM part")
def _(spark, sf):
    cells = F.split(F.concat_ws(" | ", "p_name", "p_brand"), " \\| ")
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), 3)), 1, 3)
    return table(spark, sf, "part").select("p_partkey", padded[0].alias("a"), padded[1].alias("b"), padded[2].alias("c"))


@query("a27_chart_json", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS labels, CAST(count(*) AS DOUBLE) AS total FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("n"))
    packed = counts.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n"))).alias("x"))
    series = F.array(F.struct(F.lit("customers").alias("name"), F.transform("x", lambda a: a["n"]).alias("values")))
    spec = charts.chart_json(F.lit("bar"), F.transform("x", lambda a: a["c_mktsegment"]), series)
    back = F.from_json(spec, "type string, data struct<labels: array<string>, datasets: array<struct<label: string, data: array<double>>>>")
    return packed.select("c_nationkey", back.alias("j")).select("c_nationkey", F.size("j.data.labels").cast("long").alias("labels"), F.aggregate(F.col("j.data.datasets")[0]["data"], F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("k02_progress_states", "SELECT user_id, event_id, CASE WHEN n = 1 THEN 'pending' WHEN event_type = 'error' THEN 'failed' WHEN n >= 10 THEN 'indexed' ELSE 'processing' END AS status, least(100, 10 * n) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def _(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf, "events").withColumn("n", n)
    status = F.when(F.col("n") == 1, "pending").when(F.col("event_type") == "error", "failed").when(F.col("n") >= 10, "indexed").otherwise("processing")
    return rows.select("user_id", "event_id", status.alias("status"), F.least(F.lit(100), 10 * F.col("n")).alias("progress"))


@query("interval_join", "SELECT a.event_id AS purchase, count(*) AS clicks FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts GROUP BY a.event_id")
def _(spark, sf):
    events = table(spark, sf, "events")
    a = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("at"))
    b = events.filter("event_type = 'click'").select("user_id", "ts")
    near = a.join(b, "user_id").filter(F.col("ts").between(F.col("at") - F.expr("INTERVAL 1 DAY"), F.col("at")))
    return near.groupBy("purchase").agg(F.count("*").alias("clicks"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("i02_numeric_like", "SELECT p_partkey, regexp_matches(p_type, '[0-9]') AS digits FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (N.is_numeric_like(F.col("p_type")) | F.col("p_type").rlike("[0-9]")).alias("digits"))
