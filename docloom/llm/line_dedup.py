"""Line dedup: later copies of repeated runs of lines are deleted. DataFrame functions only.

The corpus is a sequence of line ids (64-bit hashes; lines of blanks alone are left out). Lines that occur once break it
into segments, and on what remains prefix doubling builds the suffix array's ranks: rank 0 of a place is its line id; the
rank of its first 2^(k+1) lines is the place of the pair (rank of the first 2^k, rank of the next 2^k) among all such
pairs, sorted by range partitions. Places with equal ranks are an interval of the suffix array with a longest common
prefix of at least that many lines. An interval for a length between two powers is named by two overlapping ranks.

A run counts if it has at least min_words words. Every such run is the union of its shortest runs of min_words words that
begin at a line, and of those that end at a line; so it is enough to double up to the longest of those (min_words lines at
most), to name their intervals, to keep the earliest place of each (by document id, then place) and to delete the lines of
all others. What is deleted are exactly the lines that lie in a run of min_words words or more that stands earlier too, and
blank lines between two such lines.

Words of a line: its blanks (U+0020) plus one. Lines end at \\n.

Cases: null text stays null, empty text stays empty; a document all of whose lines are later copies gets an empty text;
a very long text is a row of many lines, whose runs to delete come together in one row of edits; null ids come first in the
order; rows that agree in id and text are one document and get the same result; an empty table
gives an empty table; other columns are kept, whatever their names, and are read by no step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._storage import discard, staged

MIN_WORDS = 20


def _lines(text: Column) -> Column:
    """(pos, lid, words) of each line that isn't blank."""
    each = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("pos"), F.xxhash64(line).alias("lid"), F.when(F.trim(line) == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words")))
    return F.filter(each, lambda x: x["words"] > 0)


def repeated_places(docs: DataFrame) -> DataFrame:
    """Staged (doc, seg, ord, pos, lid, words): places whose line occurs more than once, in segments of neighbours. doc: (id, hash of the text)."""
    lines = staged(docs.select("doc", F.posexplode(_lines(F.col("text"))).alias("ord", "x")).select("doc", "ord", "x.pos", "x.lid", "x.words"), "lines")
    again = lines.groupBy("lid").agg(F.count("*").alias("times")).filter("times > 1").select("lid")
    places = lines.join(again, "lid", "left_semi").dropDuplicates(["doc", "ord"])
    place = F.row_number().over(Window.partitionBy("doc").orderBy("ord"))
    out = staged(places.withColumn("seg", F.col("ord") - place), "places")
    discard(lines)
    return out


def shortest_runs(places: DataFrame, min_words: int) -> DataFrame:
    """(doc, ord, len, first_pos, last_pos): for each place the shortest run of min_words words that begins there, and the one that ends there."""
    seg = Window.partitionBy("doc", "seg")
    upto = F.sum("words").over(seg.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    counted = places.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    ahead = seg.orderBy("before").rangeBetween(0, min_words - 1)
    back = seg.orderBy("upto").rangeBetween(1 - min_words, 0)
    both = counted.select(
        "doc",
        F.when(F.max("upto").over(ahead) >= F.col("before") + min_words, F.struct("ord", F.count("*").over(ahead).cast("int").alias("len"), F.col("pos").alias("first_pos"), F.max("pos").over(ahead).alias("last_pos"))).alias("a"),
        F.when(F.min("before").over(back) <= F.col("upto") - min_words, F.struct((F.col("ord") - F.count("*").over(back) + 1).cast("int").alias("ord"), F.count("*").over(back).cast("int").alias("len"), F.min("pos").over(back).alias("first_pos"), F.col("pos").alias("last_pos"))).alias("b"),
    )
    return both.select("doc", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("r")).select("doc", "r.*").distinct()


def suffix_ranks(places: DataFrame, longest: int) -> DataFrame:
    """places with r0, r1, ...: the order of the first 2^k lines of each suffix among all. null where the segment ends before."""
    ranked, k = places.withColumn("r0", F.col("lid")), 0
    while 2 << k <= longest:
        after = F.lead(f"r{k}", 1 << k).over(Window.partitionBy("doc", "seg").orderBy("ord"))
        paired = staged(ranked.withColumn("after", after), "suffixes")
        # Sorted by range partitions, so the id that grows from partition to partition is the pair's order.
        order = paired.filter("after is not null").select(f"r{k}", "after").distinct().repartitionByRange(f"r{k}", "after").sortWithinPartitions(f"r{k}", "after")
        order = staged(order.withColumn(f"r{k + 1}", F.monotonically_increasing_id()), "ranks")
        ranked = paired.join(order, [f"r{k}", "after"], "left").drop("after")
        k += 1
    return ranked


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """((doc, first_pos, last_pos, ord, len) of the runs to delete, the staged tables that it is read from). docs: doc and text."""
    places = repeated_places(docs)
    runs = staged(shortest_runs(places, min_words), "runs")
    longest = runs.agg(F.max("len")).first()[0] or 0
    ranked = staged(suffix_ranks(places, longest), "suffix-array") if longest > 1 else places.withColumn("r0", F.col("lid"))
    used = [runs, ranked, places]
    levels = max(1, int(longest).bit_length())
    rank = F.coalesce(*[F.when(F.col("level") == k, F.col(f"r{k}")) for k in range(levels)])
    level = (F.length(F.bin("len")) - 1).alias("level")
    at = ranked.select("doc", "ord", *[f"r{k}" for k in range(levels)])
    named = runs.select("*", level).join(at, ["doc", "ord"]).withColumn("ra", rank).drop(*[f"r{k}" for k in range(levels)])
    end = named.withColumn("end", (F.col("ord") + F.col("len") - F.pow(F.lit(2), "level").cast("int")).cast("int"))
    tail = at.withColumnRenamed("ord", "end")
    named = staged(end.join(tail, ["doc", "end"]).withColumn("rb", rank).select("doc", "ord", "len", "ra", "rb", "first_pos", "last_pos"), "intervals")
    first = named.groupBy("len", "ra", "rb").agg(F.min(F.struct("doc", "ord")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    discard(*used)
    return named.join(first, ["len", "ra", "rb"]).filter(F.struct("doc", "ord") > F.col("first")).select("doc", "first_pos", "last_pos", "ord", "len"), [named]


def _kept_ranges(runs: Column, total: Column) -> Column:
    """The ranges [a, b) of line places that stay. runs: sorted (first_pos, last_pos, ord, end); ord and end count lines that aren't blank."""
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("next"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))

    def step(acc, r):
        gap = F.array(F.struct(acc["at"].alias("a"), r["first_pos"].cast("int").alias("b")))
        # Only blank lines lie between runs that follow each other: they go with them.
        kept = F.when((r["ord"] > acc["next"]) & (r["first_pos"] > acc["at"]), F.concat(acc["kept"], gap)).otherwise(acc["kept"])
        return F.struct(F.greatest(acc["at"], (r["last_pos"] + 1).cast("int")).alias("at"), F.greatest(acc["next"], (r["end"] + 1).cast("int")).alias("next"), kept.alias("kept"))

    def finish(acc):
        return F.when(total > acc["at"], F.concat(acc["kept"], F.array(F.struct(acc["at"].alias("a"), total.alias("b"))))).otherwise(acc["kept"])

    return F.aggregate(runs, start, step, finish)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id", counts: bool = False) -> DataFrame:
    """docs, whole rows, with later copies of repeated runs deleted from the text. counts: with n_lines_before and n_lines_deleted."""
    text, kept = F.col(f"`{text_col}`"), [c for c in docs.columns if c != text_col]
    # The caller's columns travel in a struct, so their names meet none of ours; the text travels once.
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    gone, used = later_copies(rows.select(F.struct("id", "h").alias("doc"), "text"), min_words)
    edits = gone.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("first_pos", "last_pos", "ord", (F.col("ord") + F.col("len") - 1).alias("end")))).alias("runs"))
    edits = staged(edits.select(F.col("doc.id").alias("edit_id"), F.col("doc.h").alias("edit_h"), "runs"), "edits")
    discard(*used)
    # One plan at every size: texts and edits meet in a merge join.
    joined = rows.join(edits.hint("merge"), (F.col("h") == F.col("edit_h")) & F.col("id").eqNullSafe(F.col("edit_id")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    joined = joined.withColumn("kept", F.when(F.col("runs").isNotNull(), _kept_ranges(F.col("runs"), F.size(lines))))
    left = F.flatten(F.transform("kept", lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"])))
    new = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    before = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    deleted = F.when(F.col("kept").isNull(), 0).otherwise(before - F.aggregate("kept", F.lit(0), lambda acc, r: acc + r["b"] - r["a"]))
    extra = [before.cast("long").alias("n_lines_before"), deleted.cast("long").alias("n_lines_deleted")] if counts else []
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"row.c{kept.index(c)}").alias(c) for c in docs.columns], *extra)


def drop_copies(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """dedup_lines without the documents of which no word is left; documents that had none stay."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    done = dedup_lines(packed, min_words, "text", "id", counts=True)
    emptied = (F.col("n_lines_deleted") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    left = done.filter(~F.coalesce(emptied, F.lit(False)))
    return left.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: What the query returns, said in SQL: every run is found by comparing the lines themselves.
SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), n AS (
  SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM l WHERE trim(line, ' ') <> ''
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ord) AS c FROM n
), ahead AS (
  SELECT a.doc_id, a.ord AS s, min(b.ord) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.ord BETWEEN a.ord AND a.ord + {MIN_WORDS} AND b.c >= a.c - a.w + {MIN_WORDS} GROUP BY ALL
), back AS (
  SELECT b.doc_id, max(a.ord) AS s, b.ord AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.ord BETWEEN b.ord - {MIN_WORDS} AND b.ord AND a.c - a.w <= b.c - {MIN_WORDS} GROUP BY b.doc_id, b.ord
), runs AS (
  SELECT r.doc_id, r.s, r.e, min(n.pos) AS p, max(n.pos) AS q, string_agg(n.line, chr(10) ORDER BY n.ord) AS body
  FROM (SELECT * FROM ahead UNION SELECT * FROM back) r JOIN n ON r.doc_id = n.doc_id AND n.ord BETWEEN r.s AND r.e GROUP BY r.doc_id, r.s, r.e
), later AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, s) > 1
), goneline AS (
  SELECT DISTINCT n.doc_id, n.ord, n.pos FROM n JOIN later g ON n.doc_id = g.doc_id AND n.ord BETWEEN g.s AND g.e
), gone AS (
  SELECT doc_id, pos FROM goneline UNION
  SELECT l.doc_id, l.pos FROM goneline a JOIN goneline b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 JOIN l ON l.doc_id = a.doc_id AND l.pos > a.pos AND l.pos < b.pos
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id
), total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_lines, t.n - coalesce(k.n, 0) AS n_deleted, sha256(coalesce(k.text, '')) AS text_sha256
FROM total t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
