"""Joins between sheets: discovery by value overlap, validation and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a workbook beyond which no join is looked for.
MAX_COLUMNS = 250


def stacked(sheets: dict[str, DataFrame]) -> DataFrame:
    """(sheet, col, value): every non-blank cell of all sheets, as trimmed text."""

    def melt(name: str, df: DataFrame) -> DataFrame:
        # Text that no engine writes in a way of its own: cents and days.
        text = {"double": lambda c: F.col(c).cast("decimal(18,2)").cast("string"), "float": lambda c: F.col(c).cast("decimal(18,2)").cast("string"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd")}
        value = lambda c, kind: F.trim(text.get(kind, lambda x: F.col(x).cast("string"))(c))
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), value(c, kind).alias("value")) for c, kind in df.dtypes])).alias("x")
        return df.select(F.lit(name).alias("sheet"), cells).select("sheet", "x.col", "x.value").filter("value <> ''")

    return reduce(DataFrame.unionByName, [melt(n, d) for n, d in sheets.items()])


def column_overlaps(sheets: dict[str, DataFrame], least: float = 0.85) -> DataFrame:
    """(sheet, col, hub, hub_col, overlap): the share of a column's distinct values that another sheet's column has.

    One equi-join on values of the distinct cells; nothing pairs columns that share no value.
    """
    if sum(len(d.columns) for d in sheets.values()) > MAX_COLUMNS:
        raise ValueError("too many columns for join discovery")
    cells = stacked(sheets).distinct()
    sizes = cells.groupBy("sheet", "col").agg(F.count("*").alias("ndv"))
    other = cells.select(F.col("sheet").alias("hub"), F.col("col").alias("hub_col"), "value")
    # A value stands in at most MAX_COLUMNS columns, so a value's pairs are bounded.
    shared = cells.join(other, "value").filter("sheet <> hub").groupBy("sheet", "col", "hub", "hub_col").agg(F.count("*").alias("common"))
    found = shared.join(sizes, ["sheet", "col"]).withColumn("overlap", F.col("common") / F.col("ndv"))
    return found.filter(F.col("overlap") >= least).select("sheet", "col", "hub", "hub_col", "overlap")


def best_joins(overlaps: DataFrame) -> DataFrame:
    """The best column pair of each pair of sheets, with the number of sheets that point at its hub."""
    w = Window.partitionBy("sheet", "hub").orderBy(F.desc("overlap"), "col", "hub_col")
    best = overlaps.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return best.withColumn("hub_degree", F.count("*").over(Window.partitionBy("hub")))


def pair_joins(overlaps: DataFrame) -> DataFrame:
    """The best join between each two sheets, whichever of them refers to the other, with the number of sheets that point at its hub."""
    pair = [F.least("sheet", "hub"), F.greatest("sheet", "hub")]
    best = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("overlap"), "sheet", "col", "hub_col"))
    return overlaps.withColumn("_r", best).filter("_r = 1").drop("_r").withColumn("hub_degree", F.count("*").over(Window.partitionBy("hub")))


def assign_roles(joins: DataFrame) -> list[dict]:
    """Greedy choice among the joins of a workbook: a sheet is either a hub or joins one hub.

    There is one join at most for two sheets, and MAX_COLUMNS bounds the sheets, so all of them come to the driver.
    """
    rows = sorted((r.asDict() for r in joins.collect()), key=lambda r: (-r["hub_degree"], -r["overlap"], r["hub"], r["sheet"]))
    hubs, taken, out = set(), set(), []
    for r in rows:
        if r["sheet"] in hubs or r["sheet"] in taken or r["hub"] in taken:
            continue
        hubs.add(r["hub"])
        taken.add(r["sheet"])
        out.append(r)
    return out


def validate_join(satellite: DataFrame, key: str, primary: DataFrame, primary_key: str) -> DataFrame:
    """One row: matched and non-blank rows, their ratio, the verdict, and one_to_many or one_to_one by how often keys repeat."""
    keys = satellite.select(F.trim(F.col(key).cast("string")).alias("k")).filter("k <> ''")
    known = primary.select(F.trim(F.col(primary_key).cast("string")).alias("p")).distinct()
    seen = keys.join(known, keys["k"] == known["p"], "left").agg(F.count("p").alias("matched"), F.count("*").alias("total"), F.count_distinct("k").alias("ndv"))
    ratio = F.col("matched") / F.nullif(F.col("total"), F.lit(0))
    repeat = 1 - F.col("ndv") / F.nullif(F.col("total"), F.lit(0))
    verdict = F.when(ratio >= 0.9, "accepted").when(ratio >= 0.85, "soft_link").otherwise("overlap_below_threshold")
    return seen.select("matched", "total", ratio.alias("overlap"), verdict.alias("verdict"), F.when(repeat > 0.01, "one_to_many").otherwise("one_to_one").alias("cardinality"))


def enrich_one(primary: DataFrame, key: str, satellite: DataFrame, satellite_key: str, order: str, payload: str, name: str) -> DataFrame:
    """primary with the payload of the satellite's last row for its key; '' where there is none."""
    last = satellite.groupBy(F.trim(F.col(satellite_key).cast("string")).alias("_k")).agg(F.max_by(F.col(payload).cast("string"), order).alias(name))
    return primary.join(last, F.trim(F.col(key).cast("string")) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit("")))


def enrich_many(primary: DataFrame, key: str, satellite: DataFrame, satellite_key: str, order: str, payload: str, name: str, shown: int = 3) -> DataFrame:
    """primary with the first values of the satellite's rows for its key, and how many more there are.

    Ranked, then summed: no group is collected whole.
    """
    rows = satellite.select(F.trim(F.col(satellite_key).cast("string")).alias("_k"), F.col(order).alias("_o"), F.trim(F.col(payload).cast("string")).alias("_v")).filter("_v <> ''")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_o", "_v")))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= shown, F.struct("_r", "_v")))), lambda x: x["_v"]), ", ")
    each = ranked.groupBy("_k").agg(head.alias("_head"), F.count("*").alias("_n"))
    text = F.concat("_head", F.when(F.col("_n") > shown, F.concat(F.lit(" (+"), (F.col("_n") - shown).cast("string"), F.lit(" more)"))).otherwise(""))
    summed = each.select("_k", text.alias(name))
    return primary.join(summed, F.trim(F.col(key).cast("string")) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit("")))


def tag_bands(rows: DataFrame, band: list[str], key: str, row: str) -> DataFrame:
    """For each band the sorted distinct keys and a map from row to key."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(row).alias("k"), F.col(key).cast("string").alias("v")))))
    return rows.groupBy(*band).agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("entity_keys"), pairs.alias("row_keys"))


def sheet_chunks(rows: DataFrame, sheet: list[str], order: list[str], cells: list[str], key: str, role: str) -> DataFrame:
    """Bands of a sheet as chunks: (sheet.., band, first_row, last_row, content, entity_keys, sheet_role), without those of fewer than four words."""
    size = 30 if len(cells) < 6 else 15 if len(cells) < 10 else 10
    n = F.row_number().over(Window.partitionBy(*sheet).orderBy(*order))
    line = F.array_join(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in cells]), " | ")
    numbered = rows.select(*sheet, n.alias("row"), line.alias("line"), F.nullif(F.trim(F.col(key).cast("string")), F.lit("")).alias("k")).withColumn("band", F.floor((F.col("row") - 1) / size))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    bands = numbered.groupBy(*sheet, "band").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.array_join(lines, "\n").alias("content"), F.array_sort(F.collect_set("k")).alias("entity_keys"))
    words = F.size(F.filter(F.split("content", "\\s+"), lambda w: w != ""))
    return bands.filter(words >= 4).withColumn("sheet_role", F.lit(role))


def name_links(headers: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sheet, primary_sheet, key): standalone sheets that have a column named like a cluster's key. headers: sheet, header; clusters: primary_sheet, key."""
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    named = headers.select("sheet", folded(F.col("header")).alias("_k"))
    return named.join(clusters.withColumn("_k", folded(F.col("key"))), "_k").select("sheet", "primary_sheet", "key").distinct()


def anchors(chunks: DataFrame, most: int = 3, least: float = 0.34) -> DataFrame:
    """(doc_id, entity_key, score): the entities that a question's hits are about, the best few of each document.

    chunks: doc_id, entity_key, match (how well the entity's row answers the question), score (of the chunk).
    """
    best = chunks.filter((F.col("match") >= least) & F.col("entity_key").isNotNull()).groupBy("doc_id", "entity_key").agg(F.max(F.col("match") * F.greatest("score", F.lit(0.01))).alias("score"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "entity_key"))
    return best.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def linked_sheets(links: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, sheet, key_column) of all sheets that may hold rows of an entity: of several key columns of a sheet the one of the last kind counts.

    links: doc, sheet, key_column, kind (0 cluster, 1 soft link, 2 standalone link, 3 the chunks themselves).
    """
    return links.groupBy(doc, "sheet").agg(F.max_by("key_column", F.struct("kind", "key_column")).alias("key_column"))


def expand_anchors(hits: DataFrame, chosen: DataFrame, sheets: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, entity_key, sheet, chunk_id): for each anchor the best chunk of every linked sheet that no hit covers for it yet.

    hits: doc_id, sheet, entity_key; chosen: anchors; sheets: doc_id, sheet; index: doc_id, sheet, entity_key, chunk_id, score.
    """
    wanted = chosen.select("doc_id", "entity_key").join(sheets.select("doc_id", "sheet").distinct(), "doc_id")
    open_ = wanted.join(hits.select("doc_id", "sheet", "entity_key").distinct(), ["doc_id", "sheet", "entity_key"], "left_anti")
    found = open_.join(index, ["doc_id", "sheet", "entity_key"])
    return found.groupBy("doc_id", "entity_key", "sheet").agg(F.max_by("chunk_id", F.struct("score", -F.col("chunk_id"))).alias("chunk_id"))


def skip_expansion(tokens, phrases, sheets):
    """Whether bulk expansion is left out: a telling question (a phrase or two tokens) about a workbook of several sheets."""
    return ((F.size(phrases) > 0) | (F.size(tokens) >= 2)) & (sheets > 1)


def highlight_rows(rows: DataFrame, band: str, least: float = 0.34) -> DataFrame:
    """(band, lo, hi): the rows of a band that answer its question best, or all of it where none does well.

    rows: band, row, score, anchor (the row of the entity that brought the band in). Bands of two rows or fewer stay whole, but a single row.
    """
    best = F.max("score").over(Window.partitionBy(band))
    each = rows.withColumn("_best", best).withColumn("_won", F.col("score") >= F.col("_best") - 1e-6)
    some = lambda f, name: f(F.when(F.col(name), F.col("row")))
    found = each.groupBy(band).agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count("*").alias("n"), F.max("_best").alias("best"), some(F.min, "anchor").alias("anchor"), some(F.min, "_won").alias("wa"), some(F.max, "_won").alias("wb"))
    whole = (F.col("n") == 1) | (F.col("b") - F.col("a") <= 1) | (F.col("best") < least)
    return found.select(band, F.coalesce("anchor", F.when(whole, F.col("a")).otherwise(F.col("wa"))).alias("lo"), F.coalesce("anchor", F.when(whole, F.col("b")).otherwise(F.col("wb"))).alias("hi"))
