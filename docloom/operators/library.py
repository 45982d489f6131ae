"""The registry of documents: scopes, listings, states, digests and what a talk has used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much of a library and of a document is told.
SHOWN, SECTIONS, SHEETS, DIGEST_CHARS = 8, 8, 12, 900


def indexed(records: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Records that can be searched: indexed, with chunks, and of the scope (doc_id) where there is one."""
    ready = records.filter("status = 'indexed' and chunks > 0")
    return ready if scope is None else ready.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")


def validate_scopes(asked: DataFrame, records: DataFrame, scope: str) -> DataFrame:
    """(scope, missing, valid): how many of a scope's documents its user doesn't own. asked: scope, doc_id, user_id."""
    owned = records.select("doc_id", "user_id", F.lit(True).alias("_own")).distinct()
    return asked.join(owned, ["doc_id", "user_id"], "left").groupBy(scope).agg(F.count_if(F.col("_own").isNull()).alias("missing"), (F.count_if(F.col("_own").isNull()) == 0).alias("valid"))


def scope_formats(asked: DataFrame, records: DataFrame, scope: str) -> DataFrame:
    """(scope, pdf_only, xlsx_only): whether all of its documents are known and of one format."""
    named = asked.join(records.select("doc_id", F.lower("filename").alias("_f")), "doc_id", "left")
    every = lambda suffix: F.bool_and(F.coalesce(F.col("_f").endswith(suffix), F.lit(False)))
    return named.groupBy(scope).agg(every(".pdf").alias("pdf_only"), every(".xlsx").alias("xlsx_only"))


def inventory(records: DataFrame, user: str, order: str, shown: int = SHOWN) -> DataFrame:
    """(user, hint): a line for each of a user's first indexed documents, and how many more there are.

    Spark cuts each partition to the first shown rows of a user before the shuffle; the count is an aggregate of its own.
    """
    ready = indexed(records)
    kind = F.when(F.col("filename").contains("."), F.lower(F.regexp_extract("filename", "\\.([^.]*)$", 1))).otherwise("file")
    line = F.concat(F.lit("- "), "filename", F.lit(" ("), kind, F.lit(", "), F.col("pages").cast("string"), F.lit(" pages, "), F.col("chunks").cast("string"), F.lit(" chunks, indexed)"))
    first = ready.withColumn("_i", F.row_number().over(Window.partitionBy(user).orderBy(order))).filter(F.col("_i") <= shown)
    body = first.groupBy(user).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    counts = ready.groupBy(user).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n("), (F.col("n") - shown).cast("string"), F.lit(" more indexed documents in the library.)"))).otherwise("")
    return body.join(counts, user).select(user, F.concat(F.lit("Indexed documents available (recent):\n"), "body", more).alias("hint"))


def _first_labels(rows: DataFrame, label: Column, order: Column, limit: int, name: str) -> DataFrame:
    """(doc_id, name): the first distinct labels of a document, caseless, in order."""
    each = rows.select("doc_id", F.trim(label).alias("l"), order.alias("o")).filter("l is not null and l <> ''")
    once = each.groupBy("doc_id", F.lower("l").alias("k")).agg(F.min_by("l", "o").alias("l"), F.min("o").alias("o"))
    ranked = once.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("o"))).filter(F.col("i") <= limit)
    return ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]).alias(name))


def digests(chunks: DataFrame) -> DataFrame:
    """(doc_id, digest, sections, sheet_names): what a document holds, in a few lines, cut at a line's end after DIGEST_CHARS.

    chunks: doc_id, filename, source_format, page_number, block_index, chunk_type, section, subsection, sheet_name. Sections
    are told of text documents, sheets of spreadsheets.
    """
    text = F.col("source_format").isin("pdf", "docx")
    at = F.struct(F.coalesce("page_number", F.lit(0)).alias("p"), F.coalesce("block_index", F.lit(0)).alias("b"))
    both = chunks.filter(text).select("doc_id", F.posexplode(F.array("section", "subsection")).alias("n", "label"), at.alias("at"))
    sections = _first_labels(both, F.col("label"), F.struct("at", "n"), SECTIONS, "sections")
    sheets = _first_labels(chunks.filter("source_format = 'xlsx'"), F.col("sheet_name"), F.struct(at), SHEETS, "sheet_names")
    kinds = chunks.groupBy("doc_id", F.coalesce("chunk_type", F.lit("other")).alias("t")).agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: F.concat(x["t"], F.lit("="), x["n"].cast("string"))), ", ").alias("kinds"))
    each = chunks.groupBy("doc_id").agg(F.min("filename").alias("filename"), F.min("source_format").alias("source_format"), F.max("page_number").alias("pages"))
    out = each.join(kinds, "doc_id").join(sections, "doc_id", "left").join(sheets, "doc_id", "left")
    size = F.when(F.col("pages") > 0, F.concat(F.lit("Size: "), F.col("pages").cast("string"), F.when(F.col("source_format") == "xlsx", " sheets").otherwise(" pages")))
    lines = F.array(F.concat(F.lit("File: "), "filename", F.lit(" ("), "source_format", F.lit(")")), size, F.concat(F.lit("Chunk types: "), "kinds"), F.concat(F.lit("Sheets: "), F.array_join("sheet_names", ", ")), F.concat(F.lit("Sections:\n- "), F.array_join("sections", "\n- ")))
    digest = F.array_join(F.array_compact(lines), "\n")
    cut = F.concat(F.rtrim(F.regexp_replace(F.substring(digest, 1, DIGEST_CHARS), "\n[^\n]*$", "")), F.lit("\n..."))
    return out.select("doc_id", F.when(F.length(digest) > DIGEST_CHARS, cut).otherwise(digest).alias("digest"), "sections", "sheet_names")


def document_states(updates: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, status, progress, updates): a document's state after updates in which a null leaves a field as it is.

    It begins as pending at 0; progress stays within 0 and 100.
    """
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))
    clamped = updates.withColumn("progress", F.when(F.col("progress").isNotNull(), F.least(F.greatest("progress", F.lit(0)), F.lit(100))))
    each = clamped.groupBy(key).agg(last("status").alias("status"), last("progress").alias("progress"), F.count("*").alias("updates"))
    return each.select(key, F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("progress", F.lit(0)).alias("progress"), "updates")


def prior_tables(sources: DataFrame, talk: str, turn: str, order: str, replies: int = 3) -> DataFrame:
    """(talk, ids): the table chunks that a talk's last replies cited, the newest reply first, each once. sources: talk, turn, order, chunk_type, chunk_id."""
    back = F.dense_rank().over(Window.partitionBy(talk).orderBy(F.desc(turn)))
    recent = sources.withColumn("_b", back).filter(F.col("_b") <= replies).filter("chunk_type = 'table'")
    once = recent.groupBy(talk, "chunk_id").agg(F.min(F.struct("_b", order)).alias("o"))
    return once.groupBy(talk).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))


def request_summary(hits: DataFrame, request: str) -> DataFrame:
    """Of each request, how many hits could become a chart, and what stopped the others. hits: request, chunk_type, chartable, profiled, score."""
    outcome = F.when(F.col("chunk_type") != "table", "not_a_table").when(~F.col("chartable"), "not_chartable").when(~F.col("profiled"), "no_profile").otherwise("eligible")
    each = hits.withColumn("_o", outcome)
    kinds = [F.count_if(F.col("_o") == o).alias(o) for o in ("eligible", "not_a_table", "not_chartable", "no_profile")]
    return each.groupBy(request).agg(F.count("*").alias("n"), *kinds, F.round(F.max("score"), 4).alias("top_score"))


#: The formats of sources, the preferred ones first, and the name of a rendered copy.
FORMATS, RENDERED = [".pdf", ".docx", ".xlsx"], "viewer.pdf"


def source_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """(user_id, doc_id, path) of each record's source: the file of its name, else the first of the first format; null where there is none.

    records: user_id, doc_id, filename; files: user_id, doc_id, path. Rendered copies are no sources.
    """
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(*[F.when(name.endswith(f), i) for i, f in enumerate(FORMATS)])
    known = files.withColumn("_name", name).withColumn("_kind", kind).filter(F.col("_kind").isNotNull() & ~name.endswith(RENDERED))
    both = records.join(known, ["user_id", "doc_id"], "left")
    rank = F.when(F.col("path").isNotNull(), F.struct((~F.col("_name").eqNullSafe(F.col("filename"))).alias("other"), "_kind", "path"))
    return both.groupBy("user_id", "doc_id").agg(F.min_by("path", rank).alias("path"))


def talks(messages: DataFrame, talk: str, order: str, stamp: str) -> DataFrame:
    """(talk, title, messages, replies, updated_at): a talk is titled by its first question and was used when its last message came. messages: talk, order, role, text, stamp."""
    from docloom.functions.text import title_from_message

    asked = F.when(F.col("role") == "user", F.col(order))
    each = messages.groupBy(talk).agg(F.min_by("text", asked).alias("_first"), F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("replies"), F.max(stamp).alias("updated_at"))
    return each.select(talk, title_from_message(F.coalesce("_first", F.lit(""))).alias("title"), "messages", "replies", "updated_at")
