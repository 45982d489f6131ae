"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of the hashes of its inner s-mers stands first or last. The
choice looks at nothing outside the k-mer, so an edit elsewhere never changes it: shared passages share anchors. The
fingerprint is the bottom sketch of the anchors' hashes: the SKETCH smallest distinct 32-bit ones, in hexadecimal. Two
fingerprints' likeness is the share of common hashes among the smallest of their union, an estimate of the Jaccard
similarity of the anchor sets.

Positions place what is shared: anchors of two texts with equal hashes and one offset difference, no further apart than k
code points, are one passage, equal letter by letter. placed() uses every anchor of both texts; shared_passages joins the
anchors of a whole table on their hashes.

Cases: a very long text is fingerprinted whole, in the memory of its task; null is the empty text; an empty text has the empty fingerprint, and two empty ones have likeness 1; a text
shorter than k code points is one anchor; equal texts have equal fingerprints; rows that repeat an id are ordered by
their text; null ids come last in descending order; a single row's next document is the row itself (the last row's
next is the first); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._text import U64, mix, powers

K, S, SKETCH = 12, 5, 64


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 64-bit hashes) of the closed syncmers of a text, ties of inner hashes taken as the leftmost."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.zeros(n + 1, U64)
    np.cumsum((points + U64(1)) * powers(n), out=total[1:])
    undo = powers(n, True)

    def hashes(width: int) -> np.ndarray:
        return mix((total[width:] - total[:-width]) * undo[: n - width + 1])

    if n < k:
        return np.zeros(1, np.int64), hashes(n)
    inner = hashes(s)
    width = k - s + 1
    low = inner[: n - k + 1].copy()
    middle = np.full(n - k + 1, np.iinfo(np.uint64).max, U64)
    for j in range(1, width - 1):
        np.minimum(middle, inner[j : j + n - k + 1], out=middle)
    last = inner[width - 1 : width - 1 + n - k + 1]
    chosen = np.flatnonzero((low <= np.minimum(middle, last)) | (last < np.minimum(middle, low)))
    return chosen, mix((total[chosen + k] - total[chosen]) * undo[chosen])


def sketch(text: str, k: int = K, s: int = S, size: int = SKETCH) -> np.ndarray:
    """The smallest distinct 32-bit hashes of the anchors, ascending."""
    return smallest(anchors(text, k, s)[1], size)


def smallest(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    h = (hashes >> U64(32)).astype(np.uint32)
    if len(h) > 4 * size:
        part = np.partition(h, 3 * size)[: 3 * size + 1]
        if len(low := np.unique(part)) >= size:
            return low[:size]
    return np.unique(h)[:size]


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    if not len(a) and not len(b):
        return 1.0
    # Both are ascending and distinct, so what is common stands twice in a row.
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    union = _distinct(both)[:size]
    return float(np.count_nonzero(both[1:][twice] <= union[-1]) / len(union))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two texts by all their anchors' hashes; 1 for two empty texts."""
    a, b = np.unique(a), np.unique(b)
    both = np.intersect1d(a, b, True).size
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def placed(mine: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray], k: int = K) -> np.ndarray:
    """(start, start in the other text, length) of the passages of a text that stand in another, from all anchors of both.

    Each shared anchor is placed once: where the passage of the anchor before it goes on if it does, else at the leftmost
    place of its hash. So a text of one repeated word costs no pairs of all its places.
    """
    return _placed(Anchors(*mine), Anchors(*theirs), k)[0]


class Anchors:
    """The anchors of a text, with their order by hash, which is found once for all comparisons."""

    __slots__ = ("at", "h", "order", "sorted", "distinct")

    def __init__(self, at: np.ndarray, h: np.ndarray):
        self.at, self.h = at, h
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]
        self.distinct = _distinct(self.sorted)

    def smallest(self, size: int = SKETCH) -> np.ndarray:
        high = (self.sorted >> U64(32)).astype(np.uint32)
        # Few of the first ones are equal, so all are looked at only where too few of them differ.
        low = _distinct(high[: 4 * size])
        return (low if len(low) >= size or len(high) <= 4 * size else _distinct(high))[:size]


def _distinct(ascending: np.ndarray) -> np.ndarray:
    if len(ascending) < 2:
        return ascending
    new = np.empty(len(ascending), bool)
    new[0] = True
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    return ascending[new]


def _placed(mine: Anchors, theirs: Anchors, k: int = K) -> tuple[np.ndarray, float]:
    """(passages as placed() gives them, likeness as jaccard() gives it)."""
    at, h, other, g = mine.at, mine.h, theirs.at, theirs.h
    none = np.zeros((0, 3), np.int64)
    if not len(h) or not len(g):
        return none, 0.0 if len(h) or len(g) else 1.0
    # Of each of my anchors by hash, its first place among theirs.
    found = np.searchsorted(theirs.sorted, mine.sorted)
    found[found == len(g)] = 0
    equal = theirs.sorted[found] == mine.sorted
    both = len(_distinct(mine.sorted[equal]))
    like = both / (len(mine.distinct) + len(theirs.distinct) - both)
    if not both:
        return none, like
    first = np.full(len(h), -1, np.int64)
    first[mine.order[equal]] = theirs.order[found[equal]]
    shared = np.flatnonzero(first >= 0)
    at, h = at[shared], h[shared]
    leftmost = other[first[shared]] - at
    offset = leftmost.copy()
    near = np.empty(len(at), bool)
    near[0] = False
    np.less_equal(at[1:] - at[:-1], k, out=near[1:])
    # An anchor is looked at again whenever the one before it has moved. One at the offset of the one before it stays where it is.
    todo = np.flatnonzero(near[1:] & (offset[1:] != offset[:-1])) + 1
    while len(todo):
        wanted = offset[todo - 1]
        here = at[todo] + wanted
        place = np.minimum(np.searchsorted(other, here), len(other) - 1)
        new = np.where((other[place] == here) & (g[place] == h[todo]), wanted, leftmost[todo])
        moved = todo[new != offset[todo]]
        offset[todo] = new
        todo = moved[moved < len(at) - 1] + 1
        todo = todo[near[todo]]
    begins = np.empty(len(at), bool)
    begins[0] = True
    np.logical_or(~near[1:], offset[1:] != offset[:-1], out=begins[1:])
    start = np.flatnonzero(begins)
    last = np.append(start[1:], len(at)) - 1
    return np.stack([at[start], at[start] + offset[start], at[last] - at[start] + k], 1), like


def edited_anchors(text: str, mine: tuple[np.ndarray, np.ndarray], cut: int, following: str, theirs: tuple[np.ndarray, np.ndarray], taken: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of text[:cut] + following[:taken] from those of both texts: only the k-mers over the seam are looked at."""
    if cut + taken < k:
        return anchors(text[:cut] + following[:taken], k)
    left = max(0, cut - k + 1)
    over, hashes = anchors(text[left:cut] + following[: min(taken, k - 1)], k) if cut - left + min(taken, k - 1) >= k else (np.zeros(0, np.int64), np.zeros(0, U64))
    # A text of fewer than k points is one anchor of another kind, which no longer text has.
    a = np.searchsorted(mine[0], cut - k, "right") if len(text) >= k else 0
    b = np.searchsorted(theirs[0], taken - k, "right") if len(following) >= k else 0
    return np.concatenate([mine[0][:a], over + left, theirs[0][:b] + cut]), np.concatenate([mine[1][:a], hashes, theirs[1][:b]])


def anchor_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, position, hash) of every anchor of every text of k code points or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text or "") >= k:
                    at, h = anchors(text, k, s)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at), pa.array(h.view(np.int64))], names=["doc_id", "position", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, position long, hash long")


def shared_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = K, s: int = S, hot: int = 1000, salts: int = 16) -> DataFrame:
    """(doc_id, other_id, start, other_start, length) of every passage that two documents share, doc_id < other_id.

    Ids are distinct; null ids take no part. Hashes that occur more than hot times are dealt over salts. Every pair of equal
    anchors counts, so rows grow with the square of the documents that share a passage.
    """
    every = anchor_rows(docs.filter(F.col(id_col).isNotNull()), text_col, id_col, k, s)
    counts = every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    known = every.join(counts, "hash").withColumn("_salts", F.when(F.col("n") > hot, F.lit(salts)).otherwise(F.lit(1)))
    left = known.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "position"), F.col("_salts").cast("long")).cast("int"))
    right = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select("hash", "_salt", F.col("doc_id").alias("other_id"), F.col("position").alias("_other"))
    pairs = left.join(right, ["hash", "_salt"]).filter("doc_id < other_id").select("doc_id", "other_id", "position", (F.col("_other") - F.col("position")).alias("_offset"))
    line = Window.partitionBy("doc_id", "other_id", "_offset").orderBy("position")
    begins = F.coalesce(F.col("position") - F.lag("position").over(line) > k, F.lit(True))
    runs = pairs.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(line))
    each = runs.groupBy("doc_id", "other_id", "_offset", "_run").agg(F.min("position").alias("start"), (F.max("position") - F.min("position") + k).alias("length"))
    return each.select("doc_id", "other_id", "start", (F.col("start") + F.col("_offset")).alias("other_start"), "length")


def fingerprint_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = K, s: int = S, size: int = SKETCH) -> DataFrame:
    """(id, fingerprint) of every whole text, in one scan."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(sketch(t.as_py() or "", k, s, size)) for t in batch.column(1)], pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


PAIR = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

#: What positional matching adds for each of the two comparisons; the longest passage is the leftmost of its length.
PLACES = [("jaccard", "double"), ("n_passages", "long"), ("shared_chars", "long"), ("longest_start", "long"), ("longest_other_start", "long"), ("longest_chars", "long")]


def compare_with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", passages: bool = False) -> DataFrame:
    """Fingerprint every text, the next document's text, and the text with its last half replaced by the next one's beginning.

    passages: also match the text with the other two by all anchors and their positions (PLACES, for _edited and _next).

    Next is by descending id; the first follows the last. The texts are range-partitioned once; each range also takes the
    first row of the following range, found from the ids alone, so that no task waits for another.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quantiles = source.stat.approxQuantile(["id"], [i / n for i in range(1, n)], 0.2 / n)[0] if n > 1 else []
    cuts = np.array(sorted({int(q) for q in quantiles}), np.int64)

    def range_of(ids: pd.Series) -> np.ndarray:
        """0 for the highest ids; null ids last."""
        gone = ids.isna().to_numpy()
        at = len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy().astype(np.int64), "right")
        return np.where(gone, len(cuts) + 1, at)

    @F.pandas_udf("int")
    def only_range(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids), dtype="int32")

    # One row a range: its first id in descending order, and the range before it, which also gets that first row.
    heads = sorted((r["at"], r["id"]) for r in source.select("id").withColumn("at", only_range("id")).groupBy("at").agg(F.max("id").alias("id")).collect())
    before = {here[0]: prior[0] for prior, here in zip([heads[-1], *heads], heads, strict=False)} if heads else {}
    first = dict(heads)

    @F.pandas_udf("at int, guest int")
    def place(ids: pd.Series) -> pd.DataFrame:
        at = range_of(ids)
        guest = [before[r] if first[r] is None or first[r] == i else None for r, i in zip(at.tolist(), ids.astype(object).tolist(), strict=True)]
        return pd.DataFrame({"at": pd.Series(at, dtype="int32"), "guest": pd.array(guest, dtype="Int32")})

    own = F.struct(F.col("place.at").alias("at"), F.lit(0).alias("late"))
    sent = F.struct(F.col("place.guest").alias("at"), F.lit(1).alias("late"))
    both = F.when(F.col("place.guest").isNotNull(), F.array(own, sent)).otherwise(F.array(own))
    dealt = source.withColumn("place", place("id")).select("id", "text", F.explode(both).alias("to")).select("to.at", "to.late", "id", "text")

    spelled = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = PAIR
    if passages:
        spelled += "".join(f", {name}_{side} {kind}" for side in ("edited", "next") for name, kind in PLACES)
        for side in ("edited", "next"):
            for name, kind in PLACES:
                schema = schema.append(pa.field(f"{name}_{side}", pa.float64() if kind == "double" else pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come range by range, each in its order and then the guests; only the first guest counts.
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for at, late, i, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and held[0] == at:
                    mine = Anchors(*anchors(text))
                    out.append(_row(held, text, mine, passages))
                elif late:
                    continue
                else:
                    mine = Anchors(*anchors(text))
                held = None if late else (at, i, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ordered = dealt.repartition(n, "at").sortWithinPartitions("at", "late", F.col("id").desc_nulls_last(), "text")
    return ordered.select("at", "late", "id", "text").mapInArrow(run, spelled)


def _places(mine: Anchors, text: str, theirs: Anchors, other: str) -> tuple:
    found, like = _placed(mine, theirs)
    if min(len(text), len(other)) < K:
        # A text shorter than k is one anchor of all its letters, which stands nowhere but in its equal.
        found = np.array([[0, 0, len(text)]] if text and text == other else np.zeros((0, 3)), np.int64)
    if not len(found):
        return like, 0, 0, None, None, 0
    starts, ends = found[:, 0], np.maximum.accumulate(found[:, 0] + found[:, 2])
    covered = int(np.sum(ends - np.maximum(starts, np.append(0, ends[:-1]))))
    longest = found[np.argmax(found[:, 2])].tolist()
    return like, len(found), covered, *longest


def _row(held: tuple, following: str, following_anchors: Anchors, passages: bool = False) -> tuple:
    _, i, text, mine = held
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    theirs = Anchors(*edited_anchors(text, (mine.at, mine.h), len(text) - half, following, (following_anchors.at, following_anchors.h), min(half, len(following))))
    a, b, c = mine.smallest(), theirs.smallest(), following_anchors.smallest()
    row = (i, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c))
    if passages:
        row += (*_places(mine, text, theirs, edited), *_places(mine, text, following_anchors, following))
    return row
