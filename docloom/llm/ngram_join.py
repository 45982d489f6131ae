"""N-gram Jaccard join: near-duplicate documents by prefix filtering.

A document is the set of its distinct word shingles. All shingles are put in one global order, rare ones first; two sets
whose Jaccard similarity reaches the threshold must share one of their first few shingles (the prefix), so documents meet
only on prefix shingles that two different sets hold. Candidates then pass a length filter, a positional filter (what can
still follow the shared shingle) and a suffix filter (what follows it in either set, cut at shingles of one of them: the
differences of the lengths of the pieces bound the symmetric difference from below). What remains is verified exactly,
and a pair that has been met is never met again, so each is verified once.

Rarity is how many documents hold a shingle, counted over all of them (count_join: hash ranges add up the blocks' counts
and send the totals back). A set is an ascending array of numbers whose first byte is the rarity's rank (the count up to
127, then its logarithm) and whose others are the shingle's hash, so the array's order is the global one. Only prefix
shingles that a second document holds are sent on, with the sets of their documents; a passage that many documents share
stays out of their prefixes as long as they have a tenth (for a threshold of 0.9) of shingles of their own.

Equal sets are one entity from the start. Within a prefix shingle, members are not paired with each other: in each round a
few of them (the most widely shared ones) are compared with the rest, members already known to be connected are
not compared again, and those that have been compared with all the rest leave. So a group of thousands of near copies
costs about one comparison a member, and still no link between components is lost. The forest of components is kept from
round to round: a round's links join roots, and only these are contracted. The number of pivots grows 32-fold, and groups
of SMALL_GROUP members or fewer are finished in the second round, so rounds are few.

Cases: null or empty text, or one without words, has no shingles and is linked with nothing, not even with another such
text; a text of fewer words than a shingle is one shingle; a very long text is one set, whole, in the memory of the tasks
that verify it (8 bytes a shingle); equal texts link; rows that repeat an id count as one document's parts, each with its
own set; rows with a null id take part, but a component's id is its smallest known one (null where there is none); an
empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._storage import discard, measured, sent, small_batches, staged, tidy
from docloom.llm._text import NON_SPACE, U64, blocks, distinct_per_row, row_bounds, shingles, word_hashes
from docloom.llm.components import components
from docloom.llm.count_join import deal, with_counts

#: Pieces into which the suffix filter cuts what follows the shared shingle.
PIECES = 16
#: Members of a prefix shingle's group up to which they are compared all at once, in the second round.
SMALL_GROUP = 64
#: Bits of a shingle's hash that tell shingles apart when their documents are counted; a clash only makes one look less rare.
COUNT_BITS = 48


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct hashes, row of each, bounds of rows) of blocks of texts."""
    for lo, hi, data, offsets in blocks(column):
        words, row = word_hashes(data, offsets, NON_SPACE)
        h, row = distinct_per_row(*shingles(words, row, hi - lo, k))
        yield lo, hi, h, row, row_bounds(row, hi - lo)


def set_ids(h: np.ndarray, bounds: np.ndarray) -> list[int]:
    """A 64-bit identity of each row's set."""
    return [xxhash.xxh3_64_intdigest(h[a:b].tobytes()) - (1 << 63) for a, b in zip(bounds, bounds[1:], strict=False)]


def ranked(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shingles as numbers of the global order: the rank of their count, then their hash."""
    rank = np.where(count < 128, count, 120 + np.minimum(np.log2(np.maximum(count, 1)), 134).astype(np.int64)).astype(U64)
    return (rank << U64(56)) | (h >> U64(8))


def _survey(docs: DataFrame, k: int, part: int, whole: int, text_col: str, id_col: str) -> DataFrame:
    """Staged rows of three kinds.

    doc_id, n, e: each document, its number of shingles and its set. e, block, n, items: each set of a block that shares a
    prefix shingle. e, n, token, at, score: such a shingle, its place in the set from 0, and how many of them the set has.
    """
    schema = "kind int, doc_id long, e long, n int, block int, items binary, token long, at int, score int"
    arrow = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("e", pa.int64()), ("n", pa.int32()), ("block", pa.int32()), ("items", pa.binary()), ("token", pa.int64()), ("at", pa.int32()), ("score", pa.int32())])

    def explode(table: pa.Table) -> list[np.ndarray]:
        return [np.concatenate([h for _, _, h, _, _ in shingle_sets(table.column("text"), k)] or [np.zeros(0, U64)])]

    def rows(kind: int, length: int, **columns) -> pa.Table:
        return pa.Table.from_arrays([pa.array([kind] * length, pa.int32()), *[pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in list(arrow)[1:]]], schema=arrow)

    def finish(table: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        known = explode(table)[0] >> U64(64 - COUNT_BITS)
        known.sort()
        known = known[np.append(True, known[1:] != known[:-1])] if len(known) else known
        block = table.column("block")[0].as_py()
        ids = table.column("doc_id").to_pylist()
        seen: set[int] = set()
        out = []
        for lo, hi, h, row, bounds in shingle_sets(table.column("text"), k):
            n = np.diff(bounds)
            e = np.array(set_ids(h, bounds), np.int64)
            out.append(rows(1, hi - lo, doc_id=ids[lo:hi], n=n, e=e))
            fresh = np.zeros(hi - lo, bool)
            for i, x in enumerate(e.tolist()):
                if n[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            take = fresh[row]
            h, row = h[take], row[take]
            if not len(h):
                continue
            count = totals[0][np.searchsorted(known, h >> U64(64 - COUNT_BITS))]
            own = ranked(h, count)
            order = np.lexsort((own, row))
            own, count = own[order], count[order]
            sizes = np.where(fresh, n, 0)
            ends = np.cumsum(sizes)
            at = np.arange(len(row)) - (ends - sizes)[row]
            take = (at < (n - (-(-part * n // whole)) + 1)[row]) & (count > 1)
            owner = row[take]
            score = np.bincount(owner, minlength=hi - lo)
            out.append(rows(3, len(owner), e=e[owner], n=n[owner], token=own[take].view(np.int64), at=at[take], score=score[owner]))
            some = np.unique(owner)
            out.append(rows(2, len(some), e=e[some], n=n[some], block=[block] * len(some), items=[own[ends[i] - sizes[i] : ends[i]].tobytes() for i in some]))
        return pa.concat_tables([*out, rows(1, 0)])

    dealt, size = deal(docs, text_col, id_col)
    return staged(with_counts(dealt, size, explode, finish, schema, COUNT_BITS), "survey")


def passes_suffix_filter(x: np.ndarray, y: np.ndarray, i: int, j: int, part: int, whole: int) -> bool:
    """False only if sets x and y, which share x[i] = y[j], can't reach the threshold."""
    # |x Δ y| = |x| + |y| - 2 |x ∩ y|, and the threshold needs |x ∩ y| >= (|x| + |y|) * part / (part + whole).
    room = (len(x) + len(y)) * (whole - part)
    p, q = x[i + 1 :], y[j + 1 :]
    cuts = np.arange(1, PIECES) * len(q) // PIECES
    a = np.diff(np.searchsorted(p, q[cuts]), prepend=0, append=len(p)) if len(q) else np.array([len(p)])
    b = np.diff(cuts, prepend=0, append=len(q)) if len(q) else np.array([0])
    # The two parts before the shared shingle differ in i - j shingles at least.
    return (abs(i - j) + int(np.abs(a - b).sum())) * (part + whole) <= room


def similar(x: np.ndarray, y: np.ndarray, part: int, whole: int) -> bool:
    """Whether two sets (ascending, distinct) reach the threshold exactly."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return whole * common >= part * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, n_pairs: int, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b, i, j, ra, rb) that reach the threshold. sets: e and items, each set once."""
    arrow = pa.schema([(c, pa.int64()) for c in ("a", "b", "ra", "rb")])
    side = lambda c, v: sets.select(F.col("e").alias(c), F.col("items").alias(v))
    both = side("a", "x").join(sent(pairs, n_pairs), "a").join(side("b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, i, j in zip(batch.column(4), batch.column(5), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good.append(passes_suffix_filter(p, q, i, j, part, whole) and similar(p, q, part, whole))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in range(4)], schema=arrow)

    return both.select("a", "b", "ra", "rb", "x", "y", "i", "j").mapInArrow(tidy(run), "a long, b long, ra long, rb long")


def link_documents(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link where whole * |A ∩ B| >= part * |A ∪ B|.

    Shuffles: the texts once, some bytes for each distinct shingle of a block, and for documents that share a prefix shingle
    their sets and those shingles.
    """
    small_batches(docs.sparkSession)
    survey = _survey(docs, k, part, whole, text_col, id_col)
    infos = survey.filter("kind = 1").select("doc_id", "n", "e")
    # A set once for each token: copies in several blocks bring it several times.
    held = survey.filter("kind = 3").select("token", "e", "n", "at", "score").distinct()
    shared = survey.filter("kind = 3").groupBy("token").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).filter("lo <> hi").select("token")
    members, seen = measured(held.join(shared, "token", "left_semi").withColumn("root", F.col("e")), "members")
    rows = seen["n"]
    # Of a set in several blocks, one.
    one = survey.filter("kind = 2").groupBy("e").agg(F.min("block").alias("block"))
    one = one.join(members.select("e").distinct(), "e", "left_semi")
    sets = staged(survey.filter("kind = 2").select("e", "block", "items").join(one, ["e", "block"], "left_semi").drop("block"), "sets")

    #: Of each round, the tables (node, root) of what it joined, and of the pairs it met.
    forest: list[tuple[DataFrame, int]] = []
    met_before: list[tuple[DataFrame, int]] = []
    #: What members is read from, and other tables that only the rounds read.
    table, used = members, [sets]
    slots = 1
    while rows:
        # Prefix shingles whose members are all in one component are done.
        open_tokens = members.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many")).filter("lo <> hi").select("token", "many")
        # From the second round on, every member of a small group is compared with the rest at once.
        small = (F.col("many") <= SMALL_GROUP) & F.lit(slots > 1)
        slot = F.when(small, F.col("e")).otherwise(F.pmod(F.xxhash64("e", "token"), F.lit(slots)))
        held_before = table
        members, seen = measured(members.join(sent(open_tokens, rows), "token").withColumn("slot", slot).withColumn("small", small), "members")
        table, rows = members, seen["n"]
        discard(held_before)
        if not rows:
            break
        pivots = members.groupBy("token", "slot").agg(F.max(F.struct("score", "e", "n", "at", "root")).alias("p")).select("token", F.col("p.e").alias("b"), F.col("p.n").alias("nb"), F.col("p.at").alias("bt"), F.col("p.root").alias("rb"))
        pivots, seen = measured(pivots, "pivots")
        used.append(pivots)
        n_pivots = seen["n"]
        met = members.join(sent(pivots, n_pivots), "token").filter("root <> rb").filter((F.col("e") < F.col("b")) | ~F.col("small"))
        # Length: the smaller set must be at least the threshold's share of the larger. Position: the shared shingle and all that follows it.
        met = met.filter(F.expr(f"least(n, nb) * {whole}L >= greatest(n, nb) * {part}L"))
        met = met.filter(F.expr(f"least(n - at, nb - bt) * {part + whole}L >= (n + nb) * {part}L"))
        a_first = F.col("e") < F.col("b")
        of = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))  # noqa: B023, E731
        pairs = met.select(F.least("e", "b").alias("a"), F.greatest("e", "b").alias("b"), F.struct(of("at", "bt").alias("i"), of("bt", "at").alias("j"), of("root", "rb").alias("ra"), of("rb", "root").alias("rb")).alias("s"))
        pairs = pairs.groupBy("a", "b").agg(F.min("s").alias("s")).select("a", "b", "s.*")
        for before, n in met_before:
            pairs = pairs.join(sent(before, n), ["a", "b"], "left_anti")
        pairs, seen = measured(pairs, "pairs")
        met_before.append((pairs.select("a", "b"), seen["n"]))
        used.append(pairs)
        links = staged(_verify(pairs, seen["n"], sets, part, whole), "links") if seen["n"] else pairs
        members = members.join(sent(pivots.select("token", F.col("b").alias("e")), n_pivots), ["token", "e"], "left_anti").drop("many", "slot", "small")
        if seen["n"]:
            joined, n_joined = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
            discard(links)
            used.append(joined)
            if n_joined:
                forest.append((joined, n_joined))
                members = members.join(sent(joined.select(F.col("node").alias("root"), F.col("root").alias("_up")), n_joined), "root", "left").withColumn("root", F.coalesce("_up", "root")).drop("_up")
        slots *= 32

    named = infos.groupBy("e").agg(F.min("doc_id").alias("own")).withColumn("root", F.col("e"))
    for joined, n in forest:
        named = named.join(sent(joined.select(F.col("node").alias("root"), F.col("root").alias("_up")), n), "root", "left").withColumn("root", F.coalesce("_up", "root")).drop("_up")
    if forest:
        named = staged(named, "roots")
        discard(*used, table)
        least = named.groupBy("root").agg(F.min("own").alias("component_id"))
        named = named.join(least, "root").select("e", "component_id")
    else:
        discard(*used, table)
        named = named.select("e", F.col("own").alias("component_id"))
    out = infos.join(named, "e", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs, whole rows, with the smallest id of each component; rows that repeat a kept id are one document and stay."""
    linked = link_documents(docs, k, part, whole, text_col, id_col)
    gone = linked.groupBy("doc_id").agg(F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("kept")).filter("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_gone")) if "_gone" not in docs.columns else docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
