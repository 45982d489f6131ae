"""Queries over grids: a table for each customer's orders, with odd headers, missing cells, empty columns and rows of periods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import tables as T
from docloom.plans.registry import query, table
from docloom.sources.folders import staged

#: The grids as cells (table_id, row, col, cell), in SQL; order_cells makes the same.
_CELLS = """
o AS (SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderpriority AS p, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
h AS (SELECT DISTINCT table_id FROM o),
cells AS (
  SELECT table_id, 0 AS row, 0 AS col, CASE WHEN table_id % 9 = 8 THEN '' ELSE 'Metric' END AS cell FROM h
  UNION ALL SELECT table_id, 0, 1, CASE table_id % 5 WHEN 1 THEN 'FY2023' WHEN 2 THEN 'Total' WHEN 3 THEN 'Price' WHEN 4 THEN 'Q3 2023' ELSE '2023' END FROM h
  UNION ALL SELECT table_id, 0, 2, CASE table_id % 5 WHEN 1 THEN '(USD Million) 2024' WHEN 2 THEN 'Half' WHEN 3 THEN 'Status' WHEN 4 THEN 'Q4 2023' ELSE '2024' END FROM h
  UNION ALL SELECT table_id, 0, 3, CASE table_id % 4 WHEN 0 THEN 'YoY' WHEN 1 THEN '' WHEN 2 THEN 'Share of all' ELSE 'Metric' END FROM h
  UNION ALL SELECT table_id, r, 0, CASE WHEN table_id % 6 = 5 THEN CAST(1990 + r AS VARCHAR) WHEN table_id % 8 = 3 AND r % 3 = 0 THEN '' ELSE p || ' ' || r END FROM o
  UNION ALL SELECT table_id, r, 1, CASE WHEN v % 17 = 0 THEN '' WHEN table_id % 10 = 7 THEN '(' || v || ')' WHEN table_id % 11 = 0 THEN CAST(v % 40 AS VARCHAR) ELSE CAST(v AS VARCHAR) END FROM o
  UNION ALL SELECT table_id, r, 2, CASE WHEN table_id % 5 = 3 THEN s ELSE CAST(v // 2 AS VARCHAR) END FROM o
  UNION ALL SELECT table_id, r, 3, CASE table_id % 4 WHEN 0 THEN (v % 90) || '%' WHEN 1 THEN '' WHEN 2 THEN (v % 90) || '%' ELSE s END FROM o WHERE NOT (table_id % 7 = 0 AND r % 2 = 0)
)"""


def order_cells(spark, sf):
    orders = table(spark, sf, "orders")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = orders.select(F.col("o_custkey").alias("table_id"), r.alias("r"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.floor("o_totalprice").cast("long").alias("v"))
    t = F.col("table_id")

    def case(modulus, names, default):
        out = F.when(F.lit(False), "")
        for k, name in names.items():
            out = out.when(t % modulus == k, name)
        return out.otherwise(default)

    def rows(df, row, *cells):
        each = F.array(*[F.struct(F.lit(i).alias("col"), c.alias("cell")) for i, c in enumerate(cells)])
        return df.select("table_id", row.cast("int").alias("row"), F.explode(each).alias("x")).select("table_id", "row", "x.col", "x.cell")

    head = rows(
        o.select("table_id").distinct(), F.lit(0), F.when(t % 9 == 8, "").otherwise("Metric"),
        case(5, {1: "FY2023", 2: "Total", 3: "Price", 4: "Q3 2023"}, "2023"),
        case(5, {1: "(USD Million) 2024", 2: "Half", 3: "Status", 4: "Q4 2023"}, "2024"),
        case(4, {0: "YoY", 1: "", 2: "Share of all"}, "Metric"),
    )
    s = lambda c: c.cast("string")
    v = F.col("v")
    share = F.concat(s(v % 90), F.lit("%"))
    body = rows(
        o, F.col("r"), F.when(t % 6 == 5, s(1990 + F.col("r"))).when((t % 8 == 3) & (F.col("r") % 3 == 0), "").otherwise(F.concat("p", F.lit(" "), s(F.col("r")))),
        F.when(v % 17 == 0, "").when(t % 10 == 7, F.concat(F.lit("("), s(v), F.lit(")"))).when(t % 11 == 0, s(v % 40)).otherwise(s(v)),
        F.when(t % 5 == 3, F.col("s")).otherwise(s(F.floor(v / 2))),
        case(4, {0: share, 1: F.lit(""), 2: share}, F.col("s")),
    )
    return head.unionByName(body.filter(~((t % 7 == 0) & (F.col("row") % 2 == 0) & (F.col("col") == 3))))


#: A number, a period and a financial value, as the functions of functions/numeric.py read the cells above.
_NUM = "(CASE WHEN regexp_full_match({0}, '\\(?[0-9,]+(\\.[0-9]+)?%?\\)?') THEN (CASE WHEN {0} LIKE '(%)' THEN -1 ELSE 1 END) * CAST(regexp_replace({0}, '[(),%]', '', 'g') AS DOUBLE) END)"
_PERIOD = "(CASE WHEN regexp_full_match({0}, '(FY|CY)?\\s*\\d{{4}}') THEN CASE WHEN CAST(right({0}, 4) AS INT) BETWEEN 1900 AND 2099 THEN right({0}, 4) END WHEN regexp_full_match({0}, 'Q[1-4] \\d{{4}}') THEN replace({0}, ' ', '') WHEN regexp_matches({0}, '(^|[^0-9])(19|20)\\d{{2}}($|[^0-9])') THEN regexp_extract({0}, '(19|20)\\d{{2}}') END)"
_FIN = "(regexp_full_match({0}, '[-0-9(),.% ]+') AND regexp_matches({0}, '[0-9]') AND NOT regexp_full_match({0}, '\\d{{4}}'))"

_ROWS = f""", full_rows AS (SELECT table_id, row, count(*) AS width, max(CASE WHEN col = 0 AND cell <> '' THEN 1 ELSE 0 END) AS labelled FROM cells GROUP BY ALL),
cols AS (SELECT table_id, col, max(cell) FILTER (WHERE row = 0) AS header, count(*) FILTER (WHERE row > 0 AND cell <> '') AS filled, count(*) FILTER (WHERE row > 0 AND regexp_matches(cell, '[0-9]')) AS digits,
  count(*) FILTER (WHERE row > 0 AND {_NUM.format('cell')} IS NOT NULL) AS numbers, count(*) FILTER (WHERE row > 0 AND contains(cell, '%') AND {_NUM.format('cell')} IS NOT NULL) AS shares,
  count(*) FILTER (WHERE row > 0 AND {_NUM.format('cell')} BETWEEN 1900 AND 2099) AS years, count(*) FILTER (WHERE row > 0 AND {_NUM.format('cell')} < 1000 AND {_NUM.format('cell')} = floor({_NUM.format('cell')})) AS small, count(DISTINCT CASE WHEN row > 0 THEN {_NUM.format('cell')} END) AS vals
  FROM cells GROUP BY table_id, col),
pr AS (SELECT *, {_PERIOD.format('header')} AS period, {_PERIOD.format('header')} IS NULL AND CASE WHEN header = '' THEN filled = 0 ELSE regexp_full_match(header, '[A-Za-z]{{1,3}}') OR filled = 0 OR shares >= 0.75 * filled END AS note FROM cols)"""
_LAYOUT = (
    _ROWS
    + f""", wide AS (SELECT table_id, count(DISTINCT period) FILTER (WHERE col > 0 AND NOT note) AS n_periods FROM pr GROUP BY table_id HAVING count(*) >= 3 AND count(*) FILTER (WHERE col > 0 AND NOT note AND period IS NULL) = 0 AND count(DISTINCT period) FILTER (WHERE col > 0 AND NOT note) >= 2),
lab AS (SELECT table_id, row, cell, {_PERIOD.format('cell')} AS period, cell <> '' AND {_PERIOD.format('cell')} IS NULL AND NOT {_FIN.format('cell')} AS metric FROM cells WHERE row > 0 AND col = 0),
labs AS (SELECT table_id, count(*) AS n, count(period) AS named, count(DISTINCT period) AS kinds, avg(CASE WHEN metric THEN 1.0 ELSE 0.0 END) AS labels FROM lab GROUP BY table_id),
long AS (SELECT p.table_id, any_value(l.kinds) AS n_periods, count(*) FILTER (WHERE col > 0 AND NOT note) AS metrics FROM pr p JOIN labs l USING (table_id) WHERE l.n >= 2 AND l.named = l.n AND l.kinds = l.n GROUP BY p.table_id HAVING count(*) >= 3 AND count(*) FILTER (WHERE col > 0 AND NOT note AND (header = '' OR period IS NOT NULL)) = 0 AND count(*) FILTER (WHERE col > 0 AND NOT note) >= 1 AND count(DISTINCT header) FILTER (WHERE col > 0 AND NOT note) = count(*) FILTER (WHERE col > 0 AND NOT note)),
pc AS (SELECT table_id, period, min(col) AS col FROM pr WHERE col > 0 AND NOT note AND period IS NOT NULL GROUP BY ALL),
cellv AS (SELECT c.table_id, c.row, c.col, l.cell AS name, l.period AS rowp, pc.period AS colp, {_NUM.format('c.cell')} AS value, contains(c.cell, '%') AND {_NUM.format('c.cell')} IS NOT NULL AS share, pr.header, pr.note FROM cells c JOIN lab l ON l.table_id = c.table_id AND l.row = c.row JOIN pr ON pr.table_id = c.table_id AND pr.col = c.col LEFT JOIN pc ON pc.table_id = c.table_id AND pc.col = c.col WHERE c.row > 0 AND c.col > 0),
ws AS (SELECT table_id, (labels + numbers + 1) / 3 AS wide_score FROM wide JOIN labs USING (table_id) JOIN (SELECT table_id, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS numbers FROM cellv WHERE colp IS NOT NULL GROUP BY table_id) USING (table_id) WHERE labels >= 0.6 AND numbers >= 0.75),
ls AS (SELECT table_id, (numbers + 1) / 2 AS long_score FROM long JOIN (SELECT table_id, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS numbers FROM cellv WHERE NOT note GROUP BY table_id) USING (table_id) WHERE numbers >= 0.75),
scores AS (SELECT coalesce(ws.table_id, ls.table_id) AS table_id, wide_score, long_score FROM ws FULL OUTER JOIN ls ON ws.table_id = ls.table_id),
wser AS (SELECT c.table_id, 'wide' AS orientation, any_value(name) AS name, row AS place, count(*) AS k, bool_and(value BETWEEN 0 AND 100) AS part, sum(value) AS total FROM cellv c JOIN wide USING (table_id) WHERE colp IS NOT NULL GROUP BY c.table_id, row HAVING any_value(name) <> '' AND NOT {_FIN.format("any_value(name)")} AND count(value) = count(*) AND avg(CASE WHEN share THEN 1.0 ELSE 0.0 END) < 0.75),
lser0 AS (SELECT c.table_id, 'long' AS orientation, header AS name, col AS place, count(*) AS k, count(value) AS got, bool_and(value BETWEEN 0 AND 100) AS part, sum(value) AS total FROM cellv c JOIN long USING (table_id) WHERE NOT note GROUP BY c.table_id, header, col),
lser AS (SELECT table_id, orientation, name, place, k, part, total FROM lser0 WHERE table_id NOT IN (SELECT table_id FROM lser0 WHERE got < k)),
ser AS (SELECT * FROM wser UNION ALL SELECT * FROM lser),
chosen AS (SELECT table_id, CASE WHEN long_score IS NULL OR wide_score > long_score THEN 'wide' ELSE 'long' END AS orientation FROM scores WHERE wide_score IS NULL OR long_score IS NULL OR abs(wide_score - long_score) >= 0.25),
prof AS (SELECT table_id, orientation, max(k) AS period_count, count(*) AS metric_count, CASE WHEN count(*) = 1 AND max(k) >= 3 THEN 'line' ELSE 'bar' END AS chart_type FROM ser JOIN chosen USING (table_id, orientation) GROUP BY ALL HAVING NOT bool_or(k >= 3 AND part AND total BETWEEN 90 AND 110) AND max(k) >= 2),
lc AS (SELECT pr.*, coalesce(lower(trim(header)) IN ('country', 'nation', 'region', 'name', 'entity', 'year', 'rank', 'id', '#') OR filled = 0 OR CASE WHEN numbers = filled AND (lower(header) = 'year' OR years = filled) THEN vals <= greatest(1, filled // 2) WHEN numbers = filled AND small = filled THEN true ELSE 1 - numbers / filled::DOUBLE >= 0.5 END, false) AS label FROM pr),
em AS (SELECT *, col > 0 AND NOT note AND NOT label AND numbers >= 0.5 * filled AS metric FROM lc WHERE table_id NOT IN (SELECT table_id FROM wide UNION SELECT table_id FROM long)),
eg AS (SELECT table_id FROM em GROUP BY table_id HAVING count(*) >= 3 AND count(*) FILTER (WHERE col > 0 AND period IS NOT NULL) = 0 AND count(*) FILTER (WHERE metric) >= 2 AND count(*) FILTER (WHERE metric AND header = '') = 0),
ps AS (SELECT table_id, CASE WHEN count(*) = 2 THEN 1 ELSE min(col) FILTER (WHERE col > 0 AND period IS NOT NULL) END AS at, CASE WHEN count(*) = 2 THEN 'category_value' ELSE 'snapshot' END AS layout FROM pr GROUP BY table_id HAVING count(*) = 2 OR count(*) FILTER (WHERE col > 0 AND period IS NOT NULL) = 1),
prow AS (SELECT ps.table_id, layout, l.cell <> '' AND NOT {_FIN.format("l.cell")} AND coalesce({_NUM.format("c.cell")} >= 0, false) AS good, {_NUM.format("c.cell")} AS value FROM ps JOIN lab l USING (table_id) LEFT JOIN cells c ON c.table_id = ps.table_id AND c.row = l.row AND c.col = ps.at),
pie AS (SELECT table_id, layout, count(*) AS slices, sum(value) AS total FROM prow GROUP BY ALL HAVING bool_and(good) AND count(*) BETWEEN 2 AND 12 AND sum(value) > 0)"""
)


@query(
    "b20_table_acceptance_rules",
    f"""WITH {_CELLS}{_ROWS}, s AS (SELECT r.table_id, count(*) - 1 AS n, any_value(h.width) AS head, count(*) FILTER (WHERE r.row > 0 AND r.width <> h.width) AS odd, sum(CASE WHEN r.row > 0 THEN labelled ELSE 0 END) AS labelled FROM full_rows r JOIN (SELECT table_id, width FROM full_rows WHERE row = 0) h USING (table_id) GROUP BY r.table_id),
c AS (SELECT table_id, count(*) FILTER (WHERE col > 0 AND filled = 0) AS empty, count(*) FILTER (WHERE col > 0 AND filled = 0 AND header <> '') AS lost, count(*) FILTER (WHERE header <> '') AS heads, count(DISTINCT header) FILTER (WHERE header <> '') AS kinds, sum(filled) AS filled, sum(digits) AS digits FROM cols GROUP BY table_id)
SELECT table_id, CASE WHEN n < 1 THEN 'too_few_rows' WHEN odd > 0.15 * n THEN 'misalignment' WHEN labelled < 0.9 * n THEN 'label_column_sparse' WHEN lost > 0 THEN 'empty_data_column' WHEN head >= 4 AND empty > 0.5 * (head - 1) THEN 'column_collapse' WHEN heads >= 3 AND kinds < 0.5 * heads THEN 'degenerate_header' WHEN filled >= 6 AND digits < 0.15 * filled THEN 'no_tabular_data' END AS reason FROM s JOIN c USING (table_id)""",
)
def _(spark, sf):
    return T.acceptance(T.cleaned(order_cells(spark, sf)))


@query(
    "d15_label_column",
    f"""WITH {_CELLS}, e AS (SELECT table_id, col, count(*) FILTER (WHERE cell <> '') AS filled, count(*) FILTER (WHERE regexp_full_match(cell, '[-0-9(),.% ]+') AND regexp_matches(cell, '[0-9]')) AS numbers FROM cells WHERE row > 0 GROUP BY ALL),
r AS (SELECT *, (filled - 2.0 * numbers) / filled AS score, row_number() OVER (PARTITION BY table_id ORDER BY (filled - 2.0 * numbers) / filled DESC, col) AS i FROM e WHERE filled > 0),
n AS (SELECT table_id, count(DISTINCT row) AS n FROM cells WHERE row > 0 GROUP BY table_id), b AS (SELECT * FROM r WHERE i = 1 AND score > 0.3), t AS (SELECT table_id, sum(numbers) / sum(filled)::DOUBLE AS numeric FROM e GROUP BY table_id),
x AS (SELECT table_id, n, col AS label_col, CASE WHEN b.col IS NULL THEN 1.0::DOUBLE ELSE 1 - filled / n::DOUBLE END AS empty_ratio, numeric AS numeric_ratio FROM n JOIN t USING (table_id) LEFT JOIN b USING (table_id))
SELECT table_id, label_col, round(empty_ratio, 6) AS empty_ratio, round(numeric_ratio, 6) AS numeric_ratio, (n >= 4 AND numeric_ratio >= 0.6 AND empty_ratio >= 0.6) OR (n >= 3 AND numeric_ratio <= 0.05) AS label_loss FROM x""",
)
def _(spark, sf):
    found = T.label_columns(T.cleaned(order_cells(spark, sf)))
    return found.withColumn("empty_ratio", F.round("empty_ratio", 6)).withColumn("numeric_ratio", F.round("numeric_ratio", 6))


#: Sheets: up to two title rows, sometimes a second header row, then the orders of a customer.
_SHEETS = """
o AS (SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderpriority AS p, CAST(floor(o_totalprice) AS BIGINT) AS v, table_id % 3 AS titles, (table_id // 3) % 2 AS second FROM orders),
h AS (SELECT DISTINCT table_id, titles, second FROM o),
cells AS (
  SELECT table_id, CAST(i AS BIGINT) AS row, unnest([0, 1, 2]) AS col, unnest(['Title ' || i, '', '']) AS cell FROM h, range(0, 2) t(i) WHERE i < titles
  UNION ALL SELECT table_id, titles, unnest([0, 1, 2]), unnest(CASE WHEN second = 1 THEN ['Name', '2024', ''] ELSE ['Name', '2024', '2025'] END) FROM h
  UNION ALL SELECT table_id, titles + 1, unnest([0, 1, 2]), unnest(CASE WHEN table_id % 5 = 0 THEN ['', 'Actual', ''] ELSE ['', 'Actual', 'Budget'] END) FROM h WHERE second = 1
  UNION ALL SELECT table_id, titles + second + r, unnest([0, 1, 2]), unnest(CASE WHEN table_id % 7 = 3 THEN [p, p, CAST(v AS VARCHAR)] ELSE [p, CAST(v AS VARCHAR), CAST(v // 2 AS VARCHAR)] END) FROM o
)"""


def sheet_cells(spark, sf):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("table_id"), r.alias("r"), F.col("o_orderpriority").alias("p"), F.floor("o_totalprice").cast("long").alias("v"))
    o = o.withColumn("titles", F.col("table_id") % 3).withColumn("second", F.floor(F.col("table_id") / 3) % 2)
    h = o.select("table_id", "titles", "second").distinct()

    def rows(df, row, cells):
        return df.select("table_id", row.cast("long").alias("row"), F.posexplode(cells).alias("col", "cell"))

    texts = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    v = F.col("v")
    titled = h.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1)))).filter("i < titles")
    return (
        rows(titled, F.col("i"), texts(F.concat(F.lit("Title "), F.col("i").cast("string")), "", ""))
        .unionByName(rows(h, F.col("titles"), F.when(F.col("second") == 1, texts("Name", "2024", "")).otherwise(texts("Name", "2024", "2025"))))
        .unionByName(rows(h.filter("second = 1"), F.col("titles") + 1, F.when(F.col("table_id") % 5 == 0, texts("", "Actual", "")).otherwise(texts("", "Actual", "Budget"))))
        .unionByName(rows(o, F.col("titles") + F.col("second") + F.col("r"), F.when(F.col("table_id") % 7 == 3, texts(F.col("p"), F.col("p"), v)).otherwise(texts(F.col("p"), v, F.floor(v / 2)))))
    )


@query(
    "e04_header_span",
    f"""WITH {_SHEETS}, s AS (SELECT table_id, row, count(*) FILTER (WHERE cell <> '') AS filled, count(*) FILTER (WHERE cell <> '') / count(*)::DOUBLE AS fill, coalesce(count(*) FILTER (WHERE regexp_full_match(cell, '\\(?-?[0-9,]+\\.?[0-9]*\\)?%?')) / nullif(count(*) FILTER (WHERE cell <> ''), 0)::DOUBLE, 0) AS share FROM cells GROUP BY ALL),
f AS (SELECT table_id, coalesce(min(row) FILTER (WHERE filled > 1), min(row)) AS first FROM s GROUP BY table_id),
x AS (SELECT table_id, first, max(fill) FILTER (WHERE row = first) AS f0, max(fill) FILTER (WHERE row = first + 1) AS f1, max(share) FILTER (WHERE row = first + 1) AS s1, avg(share) FILTER (WHERE row BETWEEN first + 2 AND first + 6) AS body FROM s JOIN f USING (table_id) GROUP BY ALL)
SELECT table_id, first, first + CASE WHEN body >= 0.5 AND s1 <= 0.2 AND f1 >= f0 THEN 2 ELSE 1 END AS "end" FROM x""",
)
def _(spark, sf):
    return T.header_spans(sheet_cells(spark, sf))


@query(
    "e04_composed_headers",
    f"""WITH {_SHEETS}, s AS (SELECT table_id, row, count(*) FILTER (WHERE cell <> '') AS filled, count(*) FILTER (WHERE cell <> '') / count(*)::DOUBLE AS fill, coalesce(count(*) FILTER (WHERE regexp_full_match(cell, '\\(?-?[0-9,]+\\.?[0-9]*\\)?%?')) / nullif(count(*) FILTER (WHERE cell <> ''), 0)::DOUBLE, 0) AS share FROM cells GROUP BY ALL),
f AS (SELECT table_id, coalesce(min(row) FILTER (WHERE filled > 1), min(row)) AS first FROM s GROUP BY table_id),
x AS (SELECT table_id, first, max(fill) FILTER (WHERE row = first) AS f0, max(fill) FILTER (WHERE row = first + 1) AS f1, max(share) FILTER (WHERE row = first + 1) AS s1, avg(share) FILTER (WHERE row BETWEEN first + 2 AND first + 6) AS body FROM s JOIN f USING (table_id) GROUP BY ALL),
z AS (SELECT table_id, first, coalesce(body >= 0.5 AND s1 <= 0.2 AND f1 >= f0, false) AS two FROM x),
u AS (SELECT c.table_id, c.col, two, c.cell, last_value(nullif(c.cell, '') IGNORE NULLS) OVER (PARTITION BY c.table_id ORDER BY c.col) AS label FROM cells c JOIN z ON z.table_id = c.table_id AND c.row = first),
d AS (SELECT c.table_id, c.col, c.cell FROM cells c JOIN z ON z.table_id = c.table_id AND c.row = first + 1 AND two)
SELECT u.table_id, u.col, CASE WHEN NOT two THEN u.cell WHEN coalesce(d.cell, '') IN ('', coalesce(label, '')) THEN coalesce(label, '') WHEN coalesce(label, '') = '' THEN d.cell ELSE label || ' ' || d.cell END AS header FROM u LEFT JOIN d ON d.table_id = u.table_id AND d.col = u.col""",
)
def _(spark, sf):
    cells = sheet_cells(spark, sf)
    return T.composed_headers(cells, T.header_spans(cells))


@query("i05_annotation_columns", f"WITH {_CELLS}{_ROWS} SELECT table_id, col, note AS annotation FROM pr")
def _(spark, sf):
    return T.column_profiles(order_cells(spark, sf)).select("table_id", "col", "annotation")


@query("l02_long_layout", f"WITH {_CELLS}{_LAYOUT} SELECT table_id, n_periods, metrics FROM long")
def _(spark, sf):
    cells = order_cells(spark, sf)
    return T.long(cells, T.column_profiles(cells))


@query("d07_layout_scores", f"WITH {_CELLS}{_LAYOUT} SELECT table_id, round(wide_score, 6) AS wide_score, round(long_score, 6) AS long_score FROM scores")
def _(spark, sf):
    cells = order_cells(spark, sf)
    return T.layout_scores(cells, T.column_profiles(cells)).withColumn("wide_score", F.round("wide_score", 6)).withColumn("long_score", F.round("long_score", 6))


@query("l05_chart_profiles", f"WITH {_CELLS}{_LAYOUT} SELECT * FROM prof")
def _(spark, sf):
    return T.chart_profiles(order_cells(spark, sf))


@query("l06_chart_series", f"WITH {_CELLS}{_LAYOUT} SELECT table_id, orientation, name, k AS points, round(total, 2) AS total FROM ser JOIN prof USING (table_id, orientation) WHERE lower(trim(name)) <> 'total'")
def _(spark, sf):
    # The series of a chart's specification, checked again: totals stay out unless asked for.
    cells = T.prepared(order_cells(spark, sf))
    profiles = staged(T.column_profiles(cells))
    found = T.series(cells, profiles).join(T.chart_profiles(cells, profiles=profiles).select("table_id", "orientation"), ["table_id", "orientation"])
    total = F.aggregate(F.transform("points", lambda p: p["value"]), F.lit(0.0), lambda a, b: a + b)
    return found.filter(T.without_total(F.lit(""), F.col("name"))).select("table_id", "orientation", "name", F.size("points").cast("long").alias("points"), F.round(total, 2).alias("total"))


@query("l07_entity_grid", f"WITH {_CELLS}{_LAYOUT} SELECT table_id, col, header AS metric, row_number() OVER (PARTITION BY table_id ORDER BY col) AS place FROM em JOIN eg USING (table_id) WHERE metric")
def _(spark, sf):
    return T.entity_grids(order_cells(spark, sf))


_NARROW = _CELLS.replace("\ncells AS (", "\nall_cells AS (") + ", cells AS (SELECT * FROM all_cells WHERE CASE WHEN table_id % 2 = 0 THEN col <= 1 ELSE col IN (0, 1, 3) END)"


@query("l08_pies", f"WITH {_NARROW}{_LAYOUT} SELECT table_id, layout, slices, total FROM pie")
def _(spark, sf):
    # The same grids without some columns: a label and a value, or one period beside a comment.
    return T.pies(order_cells(spark, sf).filter(F.when(F.col("table_id") % 2 == 0, F.col("col") <= 1).otherwise(F.col("col").isin(0, 1, 3))))


@query("l09_chart_attempts", f"WITH {_CELLS}{_LAYOUT} SELECT table_id, coalesce(chart_type, CASE WHEN eg.table_id IS NOT NULL THEN 'entity_grid' END, CASE WHEN pie.table_id IS NOT NULL THEN 'pie' END) AS chart FROM h LEFT JOIN prof USING (table_id) LEFT JOIN eg USING (table_id) LEFT JOIN pie USING (table_id)")
def _(spark, sf):
    return T.chart_attempts(order_cells(spark, sf))


#: Questions about part types: words of the brand and type, a number, sometimes the word total.
_ASKED = "SELECT p_partkey AS k, lower(p_brand) || ' plot ' || (p_size % 20) || ' ' || lower(p_type) || CASE WHEN p_partkey % 3 = 0 THEN ' total' ELSE '' END AS query FROM part"
_METRICS = ["Total", "Standard Steel", "Small Brass", "Economy Tin", "Burnished", "Plated Copper"]
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t <> ''))"
_LIMIT = "list_filter(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: regexp_full_match(t, '[0-9]{{1,9}}')), lambda t: CAST(t AS INT)), lambda n: n BETWEEN 1 AND 12)[1]"


def _asked(spark, sf):
    words = F.concat(F.lower("p_brand"), F.lit(" plot "), (F.col("p_size") % 20).cast("string"), F.lit(" "), F.lower("p_type"), F.when(F.col("p_partkey") % 3 == 0, " total").otherwise(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), words.alias("query"))


@query(
    "f09_metric_choice",
    f"""WITH q AS ({_ASKED}), m AS (SELECT k, query, i AS col, {_METRICS}[i] AS metric FROM q, range(1, 7) t(i)),
s AS (SELECT *, len(list_intersect({_WORDS.format('query')}, {_WORDS.format('metric')})) / len({_WORDS.format('query')})::DOUBLE AS s FROM m WHERE contains(query, 'total') OR lower(metric) <> 'total'),
t AS (SELECT *, max(s) OVER (PARTITION BY k) AS top FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, col) AS pick FROM t WHERE top = 0 OR s > 0)
SELECT k, col, metric, pick FROM r WHERE pick <= coalesce({_LIMIT.format('query')}, 12)""",
)
def _(spark, sf):
    metrics = _asked(spark, sf).select("k", "query", F.posexplode(F.array(*map(F.lit, _METRICS))).alias("_i", "metric")).withColumn("col", F.col("_i") + 1).drop("_i")
    return T.metric_choice(metrics, "k").select("k", F.col("col").cast("long").alias("col"), "metric", "pick")


@query(
    "f10_chart_slice",
    f"""WITH q AS (SELECT k, CASE WHEN k % 4 = 1 THEN query || ' 2019' ELSE query END AS query FROM ({_ASKED})),
p AS (SELECT k, query, s AS place, {_METRICS}[s] AS name, CAST(2010 + a AS VARCHAR) AS period, a AS pos, k * s + a AS value FROM q, range(1, 7) t(s), range(0, 14) u(a) WHERE a < 3 + k % 12 AND s <= 1 + k % 6),
d AS (SELECT *, {_LIMIT.format('query')} AS lim, (max(place) OVER (PARTITION BY k)) AS ns, (max(pos) OVER (PARTITION BY k)) + 1 AS np FROM p),
e AS (SELECT *, lim IS NOT NULL AND ns >= np AND ns > 1 AS ser FROM d),
f AS (SELECT * FROM e WHERE pos < CASE WHEN ser THEN 12 ELSE coalesce(lim, 12) END),
g AS (SELECT *, len(list_intersect(list_filter({_WORDS.format('query')}, lambda t: NOT regexp_full_match(t, '[0-9]+')), {_WORDS.format('name')})) > 0 AS named FROM f),
i AS (SELECT *, bool_or(named) OVER (PARTITION BY k) AS any_named FROM g),
j AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY place) AS r FROM i WHERE named OR NOT any_named)
SELECT k, place, pos, CAST(value AS BIGINT) AS value FROM j WHERE r <= coalesce(lim, 8)""",
)
def _(spark, sf):
    asked = _asked(spark, sf).withColumn("query", F.when(F.col("k") % 4 == 1, F.concat("query", F.lit(" 2019"))).otherwise(F.col("query")))
    named = asked.select("k", "query", F.posexplode(F.array(*map(F.lit, _METRICS))).alias("_i", "name")).withColumn("place", F.col("_i") + 1).filter("place <= 1 + k % 6")
    points = named.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(13)))).filter("at < 3 + k % 12")
    points = points.select("k", "query", "name", "place", (F.col("at") + 2010).cast("string").alias("period"), "at", (F.col("k") * F.col("place") + F.col("at")).cast("long").alias("value"))
    return T.slice_series(points, "k").select("k", F.col("place").cast("long").alias("place"), F.col("at").cast("long").alias("pos"), "value")


@query("i04_period_order_key", "WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FY' || (1990 + event_id % 40) WHEN 1 THEN 'Q' || (1 + event_id % 4) || ' 2024' WHEN 2 THEN CAST(1990 + event_id % 40 AS VARCHAR) ELSE event_type END AS label FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS kind, CASE WHEN event_id % 2 = 0 THEN CAST(right(label, 4) AS BIGINT) ELSE 0 END AS year, CASE WHEN event_id % 2 = 0 THEN '' ELSE label END AS label FROM p")
def _(spark, sf):
    i = F.col("event_id")
    year = (1990 + i % 40).cast("string")
    label = F.when(i % 4 == 0, F.concat(F.lit("FY"), year)).when(i % 4 == 1, F.concat(F.lit("Q"), (1 + i % 4).cast("string"), F.lit(" 2024"))).when(i % 4 == 2, year).otherwise(F.col("event_type"))
    kind, number, text = T.period_order(label)
    return table(spark, sf, "events").select("event_id", kind.alias("kind"), number.alias("year"), text.alias("label"))


@query("g06_total_series", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Total' ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 0 OR p_brand LIKE '%1%'")
def _(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, "Total").otherwise(F.col("p_name"))
    asked = F.when(F.col("p_brand").contains("1"), F.concat(F.lit("Total of "), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").filter(T.without_total(asked, name)).select("p_partkey", name.alias("name"))
