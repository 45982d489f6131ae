"""Search over one index of chunks: hybrid ranking in a scope, slots, caps by sheet, context, sources and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import retrieval

#: How roles of sheets are ordered, and the limits of the index.
ROLES = {"standalone": 0, "satellite": 1, "primary": 2}
CONTEXT_CHARS, XLSX_CAP, SNIPPET = 12_000, 5, 240


def scope_filter(user_id: str | None = None, doc_ids: list[str] | None = None, chunk_type: str | None = None) -> Column:
    """The rows of a user, of some documents and of one kind; what is not given restricts nothing."""
    out = F.lit(True)
    if user_id is not None:
        out = out & (F.col("user_id") == str(user_id))
    if doc_ids:
        out = out & F.col("doc_id").cast("string").isin([str(d) for d in doc_ids])
    return out & (F.col("chunk_type") == chunk_type) if chunk_type else out


def hybrid_search(chunks: DataFrame, questions: DataFrame, k: int, scope: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of words and vectors together.

    chunks: chunk_id, content, embedding and what the scope reads; questions: query_id, text, vector, a stated set. The k best
    chunks by BM25 in the scope and the k nearest vectors, of which those outside the scope go afterwards, are each scaled to 0
    to 1 and averaged; what one list lacks counts 0 there, so fewer than k may come back.
    """
    words = F.array_distinct(retrieval.index_words(F.col("text")))
    terms = questions.select("query_id", F.explode(words).alias("term"))
    by_words = retrieval.bm25_top_k(chunks, terms, k, scope=scope).select("query_id", "chunk_id", "score")
    asked = questions.filter("vector is not null").select("query_id", F.col("vector").alias("query"))
    by_vector = retrieval.nearest(chunks.filter("embedding is not null"), asked, k, "chunk_id", "embedding", digits=6)
    if scope is not None:
        by_vector = by_vector.join(chunks.filter(scope).select("chunk_id"), "chunk_id", "left_semi")
    by_vector = by_vector.select("query_id", "chunk_id", (1 / (1 + F.col("distance") * F.col("distance"))).alias("score"))
    fused = retrieval.fuse(by_words, by_vector, "chunk_id").withColumn("score", F.round("score", 6))
    return retrieval.top_k(fused, k, "chunk_id")


def image_search(chunks: DataFrame, questions: DataFrame, k: int, scope: Column | None = None, shown: int = 1) -> DataFrame:
    """The shown best images of each question: hybrid search among images alone."""
    images = scope_filter(chunk_type="image")
    hits = hybrid_search(chunks, questions, k, images if scope is None else scope & images)
    return hits.filter(F.col("rank") <= shown)


def hit_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's fields; the address of an image, from its path, and no score as 0."""
    from docloom.functions.text import image_url

    return hits.join(chunks, "chunk_id").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("image_url", image_url(F.col("image_path"))).drop("image_path")


def cap_sheets(hits: DataFrame, cap: int = XLSX_CAP, group: str = "query_id") -> DataFrame:
    """Hits with at most cap of spreadsheets: one a sheet, linked sheets before primary ones, with a place kept for a primary one.

    hits: group, chunk_id, doc_id, source_format, sheet_name, sheet_role, score, length, priority (2 for chunks that cover an
    anchor, 1 for those that an anchor brought, else 0). Groups with no more than cap such hits stay as they are.
    """
    every = Window.partitionBy(group)
    sheet = F.col("source_format") == "xlsx"
    rows = hits.withColumn("_n", F.count_if(sheet).over(every))
    others = rows.filter(~sheet | (F.col("_n") <= cap))
    best = F.row_number().over(Window.partitionBy(group, "doc_id", "sheet_name").orderBy(F.desc("priority"), F.desc("score"), "length", "chunk_id"))
    kept = rows.filter(sheet & (F.col("_n") > cap)).withColumn("_b", best).filter("_b = 1")
    primary = ~F.coalesce("sheet_role", F.lit("primary")).isin("standalone", "satellite")
    kept = kept.withColumn("_p", primary).withColumn("_reps", F.count("*").over(every)).withColumn("_primary", F.count_if("_p").over(every))
    place = F.row_number().over(Window.partitionBy(group, "_p").orderBy(F.desc("score"), "length", "chunk_id"))
    kept = kept.withColumn("_i", place)
    linked = F.least(F.col("_reps") - F.col("_primary"), F.lit(cap) - F.when(F.col("_primary") > 0, 1).otherwise(0))
    chosen = F.when(F.col("_reps") <= cap, True).when(F.col("_p"), F.col("_i") <= cap - linked).otherwise(F.col("_i") <= linked)
    return others.select(*hits.columns).unionByName(kept.filter(chosen).select(*hits.columns))


def source_block(index: Column, name: Column, fmt: Column, section: Column, page: Column, kind: Column, content: Column) -> Column:
    """One numbered source as the answer's model reads it: its section for a text document, else its page."""
    where = F.when(fmt == "docx", F.when(F.coalesce(F.trim(section), F.lit("")) != "", F.concat(F.lit("Section: "), F.trim(section)))).otherwise(F.concat(F.lit("Page: "), page.cast("string")))
    lines = F.array(F.concat(F.lit("--- Source "), index.cast("string"), F.lit(" ---")), F.concat(F.lit("Document: "), name), where, F.concat(F.lit("Type: "), kind), F.concat(F.lit("Content:\n<document_excerpt>\n"), content, F.lit("\n</document_excerpt>")))
    return F.array_join(F.array_compact(lines), "\n")


def answer_context(hits: DataFrame, group: str, order: list) -> DataFrame:
    """(group, context): the text and table hits of a group as numbered sources. hits: group, filename, source_format, section, page_number, chunk_type, content."""
    shown = hits.filter(F.col("chunk_type").isin("text", "table")).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    block = source_block(F.col("_n"), F.col("filename"), F.col("source_format"), F.col("section"), F.col("page_number"), F.col("chunk_type"), F.col("content"))
    packed = F.array_sort(F.collect_list(F.struct("_n", block.alias("b"))))
    return shown.groupBy(group).agg(F.array_join(F.transform(packed, lambda x: x["b"]), "\n\n").alias("context"))


def fit_context(hits: DataFrame, group: str, budget: int = CONTEXT_CHARS) -> DataFrame:
    """The hits whose sources fit the context's budget, taken by role of the sheet, score and length; all where none fits.

    hits: group, chunk_id, sheet_role, score, length (of the content), size (of its block, without the digits of its number).
    A group is what one search returns, so it is small.
    """
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.coalesce("sheet_role", F.lit("primary"))], F.lit(2))
    item = F.struct(role.alias("role"), (-F.col("score")).alias("s"), "length", "chunk_id", F.col("size").cast("long").alias("size"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        # Two line ends part sources, and a source's number has digits.
        cost = x["size"] + F.length((acc["n"] + 1).cast("string")) + F.when(acc["n"] > 0, 2).otherwise(0)
        fits = acc["used"] + cost <= budget
        return F.when(fits, F.struct((acc["used"] + cost).alias("used"), (acc["n"] + 1).alias("n"), F.concat(acc["kept"], F.array(x["chunk_id"])).alias("kept"))).otherwise(acc)

    each = hits.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kept = F.aggregate("_items", start, step, lambda acc: acc["kept"])
    chosen = each.select(group, F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.transform("_items", lambda x: x["chunk_id"]))).alias("chunk_id"))
    return hits.join(chosen, [group, "chunk_id"], "left_semi")


def source_rows(hits: DataFrame) -> DataFrame:
    """Citations of hits: a snippet, and the places that the viewer of their format can show.

    hits: source_format, content, bbox, row_range, viewer_status, viewer_bbox, viewer_page. Spreadsheets have a row range and no
    box, text documents the box of the viewer where it was found, others their own.
    """
    fmt = F.coalesce("source_format", F.lit("pdf"))
    found = F.col("viewer_status") == "ok"
    box = F.when(fmt == "docx", F.when(found, F.col("viewer_bbox"))).when(fmt != "xlsx", F.col("bbox"))
    return hits.select(*[c for c in hits.columns if c not in ("source_format", "content", "bbox", "viewer_status", "viewer_bbox", "viewer_page")], fmt.alias("source_format"), F.substring("content", 1, SNIPPET).alias("snippet"), box.alias("bbox"), F.when(fmt == "docx", F.col("viewer_page")).alias("viewer_page"))


def merge_image_sources(sources: DataFrame, images: DataFrame, group: str = "query_id") -> DataFrame:
    """Sources with the images that were asked for: one that is there is marked, the others follow as image sources. images: group, chunk_id, caption, score."""
    marked = images.select(group, "chunk_id", "caption", F.col("score").alias("_s"), F.lit("intent").alias("_r"))
    both = sources.join(marked, [group, "chunk_id"], "full_outer")
    known = F.col("chunk_type").isNotNull()
    return both.select(group, "chunk_id", F.coalesce("chunk_type", F.lit("image")).alias("chunk_type"), F.when(known, F.col("snippet")).otherwise(F.coalesce("caption", F.lit(""))).alias("snippet"), F.when(known, F.col("score")).otherwise(F.col("_s")).alias("score"), F.col("_r").alias("attach_reason"))


def rank_tables(candidates: DataFrame, group: str = "query_id") -> DataFrame:
    """Table chunks by how well they answer a chart question: likeness of vectors, shared words, search score, and a bonus for tables of the talk so far.

    candidates: group, chunk_id, query, content, similarity, score, prior. Words are those between white space of the whole text, caseless.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda t: t != ""))
    asked = words(F.col("query"))
    shared = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(F.col("content")))) / F.size(asked)).otherwise(0.0)
    value = F.col("similarity") + 0.25 * shared + 0.05 * F.greatest(F.col("score"), F.lit(0.0)) + F.when(F.col("prior"), 1.0).otherwise(0.0)
    ranked = candidates.withColumn("relevance", F.round(value, 6))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("relevance"), "chunk_id")))


def display_images(images: DataFrame, group: str = "query_id", cap: int = 2, most_iou: float = 0.6) -> DataFrame:
    """The images to show: those asked for by score, then those near the text, none twice and none over another of its page.

    images: group, image_id, intent, score, doc_id, page, x0, top, x1, bottom. Taken one by one from a group's few images.
    """
    item = F.struct((~F.col("intent")).alias("near"), (-F.col("score")).alias("s"), "image_id", "doc_id", "page", "x0", "top", "x1", "bottom")
    items = F.array_sort(F.collect_list(item))

    def area(a):
        return (a["x1"] - a["x0"]) * (a["bottom"] - a["top"])

    def doubled(a, b):
        w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
        h = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))
        union = area(a) + area(b) - w * h
        over = (a["doc_id"] == b["doc_id"]) & (a["page"] == b["page"]) & (union > 0) & (w * h > most_iou * union)
        return (a["image_id"] == b["image_id"]) | F.coalesce(over, F.lit(False))

    def step(acc, x):
        full = F.size(acc) >= cap
        return F.when(full | F.exists(acc, lambda y: doubled(x, y)), acc).otherwise(F.concat(acc, F.array(x)))

    each = images.groupBy(group).agg(items.alias("_i"))
    kept = F.aggregate("_i", F.slice("_i", 1, 0), step)
    return each.select(group, F.posexplode(kept).alias("place", "x")).select(group, "place", "x.image_id")


def table_slots(hits: DataFrame, k: int = 6, slots: int = 2) -> DataFrame:
    return retrieval.reserve_table_slots(hits, k, slots, "query_id", "chunk_id")


def with_anchors(hits: DataFrame, chunks: DataFrame, questions: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """hits with what the entities that they are about bring along, and priority: 2 for hits that hold such an entity, 1 for chunks it brings, else 0.

    Of each question the most entities whose rows answer it best, weighted by their chunk's score, are its anchors; every
    sheet of their document that no hit covers for them adds the chunk that answers best, with score 0. hits, chunks: as in
    search_documents; entities: chunk_id, entity_key, line, the rows of spreadsheets' chunks.
    """
    from docloom.functions.text import query_tokens, row_match_score
    from docloom.operators import workbook

    told = questions.select("query_id", query_tokens(F.col("text")).alias("_t"))
    rows = hits.filter("source_format = 'xlsx'").select("query_id", "chunk_id", "doc_id", "sheet_name", "score").join(entities, "chunk_id").join(told, "query_id")
    rows = rows.withColumn("match", row_match_score(F.col("line"), F.col("_t")))
    # Anchors are chosen for a question over all its documents.
    best = workbook.anchors(rows.select(F.col("query_id").alias("doc_id"), F.struct("doc_id", "entity_key").alias("entity_key"), "match", "score"), most)
    chosen = best.select(F.struct(F.col("doc_id").alias("query_id"), F.col("entity_key.doc_id").alias("doc_id")).alias("doc_id"), F.col("entity_key.entity_key").alias("entity_key"))
    of = F.struct("query_id", "doc_id").alias("doc_id")
    held = rows.select(of, F.col("sheet_name").alias("sheet"), "entity_key", "query_id", "chunk_id")
    # What the index has of the anchors, with how well it answers the question.
    named = chosen.select(F.col("doc_id.query_id").alias("query_id"), F.col("doc_id.doc_id").alias("doc_id"), "entity_key")
    index = chunks.filter("source_format = 'xlsx'").select("chunk_id", "doc_id", "sheet_name").join(entities, "chunk_id").join(named, ["doc_id", "entity_key"]).join(told, "query_id")
    index = index.select(of, F.col("sheet_name").alias("sheet"), "entity_key", "chunk_id", row_match_score(F.col("line"), F.col("_t")).alias("score"))
    brought = workbook.expand_anchors(held, chosen, index, index).select("doc_id.query_id", "chunk_id").distinct().join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    covers = held.join(chosen, ["doc_id", "entity_key"], "left_semi").select("query_id", "chunk_id", F.lit(2).alias("priority")).distinct()
    own = hits.join(covers, ["query_id", "chunk_id"], "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    added = described(brought.withColumn("score", F.lit(0.0)), chunks).withColumn("priority", F.lit(1))
    return own.unionByName(added.select(*own.columns))


def described(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, score) with their chunks' fields and length."""
    return hits.join(chunks.select("chunk_id", "doc_id", "chunk_type", "source_format", "sheet_name", "sheet_role", F.length("content").alias("length")), "chunk_id")


def search_documents(chunks: DataFrame, questions: DataFrame, k: int = 6, slots: int = 2, pool: int = 8, scope: Column | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, chunk_type, score, rank): hybrid search, places kept for tables, chunks brought by anchors, and the cap on spreadsheets.

    chunks also have doc_id, chunk_type, source_format, sheet_name and sheet_role; questions may have earlier, an array of
    questions before, whose named phrases the question then takes along; entities: see with_anchors, none without.
    """
    if "earlier" in questions.columns:
        from docloom.operators.phrases import merge_anchor_phrases

        questions = questions.withColumn("text", merge_anchor_phrases(F.col("text"), F.col("earlier")))
    found = described(hybrid_search(chunks, questions, pool, scope).drop("rank"), chunks)
    slotted = table_slots(found, k, slots).drop("rank")
    allowed = chunks if scope is None else chunks.filter(scope)
    capped = cap_sheets(slotted.withColumn("priority", F.lit(0)) if entities is None else with_anchors(slotted, allowed, questions, entities))
    return capped.select("query_id", "chunk_id", "chunk_type", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).alias("rank"))
