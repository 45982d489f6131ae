"""Substring dedup by seed and extend: passages of words that stand in an earlier document too are removed.

Seeds. Winnowing picks, of every `size - SEED + 1` neighbouring runs of SEED words, the one of the smallest hash (the
leftmost of equals). The choice looks at nothing outside these words, so a passage of `size` words has the same anchor in
whatever document it stands, and documents are joined on anchors. A seed is an anchor with all windows of `size` words that
chose it: they follow each other, and every window belongs to one seed.

Extension. A seed is extended both ways, to the first word of its first window and the last word of its last. Seeds of one
anchor whose extents agree are one class, represented by its smallest document; so a group of copies is one class an
anchor, however large. Where an anchor has but one class, the match is maximal on both sides within the extent, and every
member but those of the smallest document is repeated. Where it has several, which differ somewhere in the extent, the
representatives' windows are compared one by one: a window is repeated where its smallest document is smaller than its own.
Neighbouring repeated windows unite to the maximal repeats, none of which is shorter than `size` words.

Nothing compares all pairs of a group: classes and windows are found by grouping on hashes (128 bits: the anchor's and the
extent's, the anchor's and the window's), with partial sums before each shuffle.

Cases: null or empty text, and one of fewer than `size` words, has no window and stays whole; a very long text is a row of
many seeds, whose ranges come together in one row; a window that repeats within its own document alone is kept; rows that
agree in id and text are one document, and rows of one id and several texts are texts of one document, of which none is
smaller; a row without id is neither smaller nor larger than any other: it stays whole, and takes nothing from others; an
empty table gives an empty table; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.llm._storage import discard, small_batches, staged, tidy
from docloom.llm._text import NON_SPACE, U64, blocks, find_words, mix, powers, span_hashes

#: Words of a window, and of a seed. A window's bits are a long, so it holds at most SEED + 62 words.
SIZE, SEED = 50, 12


class Words:
    """The words of a block of texts, and hashes of runs of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.row = find_words(data, offsets, NON_SPACE)
        n = len(self.start)
        self.total = np.zeros(n + 1, U64)
        if n:
            np.cumsum(span_hashes(data, self.start, self.end) * powers(n), out=self.total[1:])
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Of the runs of length words at the places at."""
        return mix((self.total[at + length] - self.total[at]) * powers(len(self.total), True)[at])

    def windows(self, size: int) -> np.ndarray:
        """Places where a window of size words of one row begins."""
        n = len(self.row) - size + 1
        return np.flatnonzero(self.row[:n] == self.row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of every width neighbours, the leftmost of equals."""
    place, low, done = np.arange(len(values)), values, 1
    while done < width:
        step = min(done, width - done)
        keep = low[:-step] <= low[step:]
        low, place = np.where(keep, low[:-step], low[step:]), np.where(keep, place[:-step], place[step:])
        done += step
    return place


def seeds_of(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """(anchor's hash, extent's hash, place of the first window, number of windows) of each seed of a block."""
    at = words.windows(size)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, U64), at, at
    grams = words.hashes(np.arange(len(words.row) - SEED + 1), SEED)
    anchor = leftmost_smallest(grams, size - SEED + 1)[at]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (words.row[at[1:]] != words.row[at[:-1]])))
    n, first, anchor = np.diff(np.append(new, len(at))), at[new], anchor[new]
    # The anchor's place in the extent belongs to it: equal extents have equal windows, one by one.
    extent = mix(words.hashes(first, n + size - 1) + (anchor - first).astype(U64) * U64(0xD1342543DE82EF95) + n.astype(U64))
    return grams[anchor], extent, first, n


def _columns(docs: DataFrame, text_col: str, id_col: str) -> list[Column]:
    """copy tells texts of one id apart."""
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text")]


def find_seeds(docs: DataFrame, size: int = SIZE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, copy, h, extent, first, n): every seed, its first window's place among the document's words, and its windows."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc", to_arrow_type(kind)), ("copy", pa.int64()), ("h", pa.int64()), ("extent", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets)
                h, extent, first, n = seeds_of(words, size)
                row = words.row[first]
                of = pa.array(row)
                ids, copies = (batch.column(i).slice(lo, hi - lo).take(of) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids.cast(schema[0].type), copies, pa.array(h.view(np.int64)), pa.array(extent.view(np.int64)), pa.array((first - words.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], schema=schema)

    small_batches(docs.sparkSession)
    source = docs.select(*_columns(docs, text_col, id_col)).filter("doc is not null and text is not null")
    return source.mapInArrow(tidy(run), f"doc {kind.simpleString()}, copy long, h long, extent long, first int, n int")


def _windows(docs: DataFrame, wanted: DataFrame, size: int, text_col: str, id_col: str) -> DataFrame:
    """(h, window, extent, j, lo) of each window of the wanted seeds: the j-th of its seed. wanted: doc, copy, seeds, an array of (first, n, h, extent)."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("h", pa.int64()), ("window", pa.int64()), ("extent", pa.int64()), ("j", pa.int32()), ("lo", to_arrow_type(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets)
                asked = batch.column(2).slice(lo, hi - lo)
                each = asked.flatten()
                row = np.repeat(np.arange(hi - lo), np.array(asked.value_lengths()))
                n = np.array(each.field("n"))
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                seed = np.repeat(np.arange(len(n)), n)
                at = np.repeat(words.first[row] + np.array(each.field("first")), n) + j
                of = pa.array(seed)
                ids = batch.column(1).slice(lo, hi - lo).take(pa.array(row[seed]))
                yield pa.RecordBatch.from_arrays([each.field("h").take(of), pa.array(words.hashes(at, size).view(np.int64)), each.field("extent").take(of), pa.array(j.astype(np.int32)), ids.cast(schema[4].type)], schema=schema)

    small_batches(docs.sparkSession)
    asked = docs.select(*_columns(docs, text_col, id_col)).join(wanted.hint("merge"), ["doc", "copy"])
    return asked.select("text", "doc", "seeds").mapInArrow(tidy(run), f"h long, window long, extent long, j int, lo {kind.simpleString()}")


def repeated_windows(docs: DataFrame, size: int = SIZE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Staged (doc, copy, first, repeated): seeds with windows that begin in a smaller document too; bit j of repeated is the window at word first + j."""
    if not SEED < size <= SEED + 62:
        raise ValueError(f"a window has {SEED + 1} to {SEED + 62} words")
    seeds = staged(find_seeds(docs, size, text_col, id_col), "seeds")
    classes = seeds.groupBy("h", "extent").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    anchors = classes.groupBy("h").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("classes")).filter("least < most")
    shared = staged(classes.join(anchors, "h").select("h", "extent", "lo", (F.col("classes") > 1).alias("several")), "classes", free=True)
    live = staged(seeds.join(shared, ["h", "extent"]), "extended", free=True)
    discard(seeds, shared)
    # Of a class that occurs several times in its smallest document any one will do, but all give the same.
    wanted = live.filter("several and doc = lo").groupBy("doc", "copy").agg(F.collect_list(F.struct("first", "n", "h", "extent")).alias("seeds"))
    windows = staged(_windows(docs, wanted, size, text_col, id_col), "windows", free=True)
    least = windows.groupBy("h", "window").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least < most").select("h", "window", "least")
    partly = windows.join(least, ["h", "window"]).filter("least < lo").groupBy("h", "extent").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"))
    partly = staged(partly, "partly", free=True)
    whole = F.expr("shiftleft(1L, n) - 1")
    done = live.join(partly, ["h", "extent"], "left").withColumn("repeated", F.when(F.col("doc") > F.col("lo"), whole).otherwise(F.coalesce("bits", F.lit(0))))
    out = staged(done.filter("repeated != 0").select("doc", "copy", "first", "repeated"), "repeats", free=True)
    discard(live, windows, partly)
    return out


def _unite(seeds: Column, size: int) -> Column:
    """Ascending disjoint ranges [a, b) of words, from an array of (first, repeated)."""
    starts = F.flatten(F.transform(seeds, lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda j: F.getbit(s["repeated"], j) == 1), lambda j: s["first"] + j)))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    state = F.struct(empty.alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))

    def step(acc, at):
        joins = (acc["b"] >= at) & (acc["b"] >= 0)
        done = F.when(joins | (acc["b"] < 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))
        return F.struct(done.alias("done"), F.when(joins, acc["a"]).otherwise(at).alias("a"), (at + size).alias("b"))

    def last(acc):
        return F.when(acc["b"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))

    return F.aggregate(F.array_sort(starts), state, step, last)


def repeated_ranges(docs: DataFrame, size: int = SIZE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, copy, seeds): for each document with repeats, an array of (first, repeated) as in repeated_windows."""
    found = repeated_windows(docs, size, text_col, id_col)
    return found.groupBy("doc", "copy").agg(F.collect_list(F.struct("first", "repeated")).alias("seeds"))


def maximal_repeats(docs: DataFrame, size: int = SIZE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, a, b): the maximal ranges [a, b) of words of each document, made of windows that begin in a smaller document too."""
    found = repeated_ranges(docs, size, text_col, id_col)
    return found.select(F.col("doc").alias(id_col), F.explode(_unite(F.col("seeds"), size)).alias("r")).select(f"`{id_col}`", "r.a", "r.b")


def _covered(asked: pa.ListArray, words: Words, size: int) -> np.ndarray:
    """Which words of a block lie in a repeated window. asked: of each row an array of (first, repeated), or null."""
    edge = np.zeros(len(words.row) + 1, np.int64)
    lengths = np.nan_to_num(np.array(asked.value_lengths(), float)).astype(np.int64)
    if lengths.any():
        each = asked.flatten()
        at = words.first[np.repeat(np.arange(len(asked)), lengths)] + np.array(each.field("first"))
        bits = np.array(each.field("repeated")).view(U64)
        for j in range(63):
            here = at[(bits >> U64(j)) & U64(1) == 1] + j
            np.add.at(edge, here, 1)
            np.add.at(edge, here + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(words: Words, gone: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a block's texts without the words gone, and the white space after them, or before them at a text's end."""
    edge = np.zeros(len(data) + 1, np.int64)
    row = words.row
    opens = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & np.append(False, row[1:] == row[:-1])))
    closes = np.flatnonzero(gone & ~(np.append(gone[1:], False) & np.append(row[1:] == row[:-1], False)))
    last = words.first[row[closes] + 1] == closes + 1
    begin, end = words.start[opens], words.end[closes]
    before = last & (opens > words.first[row[opens]])
    begin[before] = words.end[opens[before] - 1]
    end[~last] = words.start[closes[~last] + 1]
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return data[keep], np.append(0, np.cumsum(keep))[offsets]


def _joined(words: Words, gone: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's words that aren't gone, with a blank between each two."""
    kept = np.flatnonzero(~gone)
    row, rows = words.row[kept], len(offsets) - 1
    blank = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
    size = words.end[kept] - words.start[kept] + blank
    ends = np.cumsum(size)
    at = np.repeat(words.start[kept] - (ends - size), size) + np.arange(size.sum())
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[ends[blank] - 1] = 0x20
    return out, np.append(0, np.cumsum(np.bincount(row, size, rows).astype(np.int64)))


def remove_repeats(docs: DataFrame, size: int = SIZE, text_col: str = "text", id_col: str = "doc_id", joined: bool = False, counts: bool = False) -> DataFrame:
    """docs, whole rows, without the words of repeated windows.

    What stays keeps its white space; joined: a text becomes its kept words with one blank between them, null an empty one.
    counts: with n_words and n_removed.
    """
    ranges = repeated_ranges(docs, size, text_col, id_col)
    others = [c for c in docs.columns if c != text_col]
    # The caller's columns go by number, so their names meet none of ours.
    rows = docs.select(*_columns(docs, text_col, id_col), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = rows.join(ranges.hint("merge"), ["doc", "copy"], "left").select("text", "seeds", *[f"c{i}" for i in range(len(others))])
    kinds = {f"c{i}": docs.schema[c].dataType for i, c in enumerate(others)}
    schema = pa.schema([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), *[(c, to_arrow_type(k)) for c, k in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets)
                gone = _covered(batch.column(1).slice(lo, hi - lo), words, size)
                out, at = (_joined if joined else _cut)(words, gone, data, offsets)
                text = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.string())
                known = batch.column(0).slice(lo, hi - lo)
                if not joined and known.null_count:
                    text = pc.if_else(known.is_valid(), text, pa.scalar(None, pa.string()))
                removed = np.bincount(words.row[gone], minlength=hi - lo)
                rest = [c.slice(lo, hi - lo).cast(t) for c, t in zip(batch.columns[2:], list(schema.types)[3:], strict=True)]
                yield pa.RecordBatch.from_arrays([text, pa.array(np.diff(words.first)), pa.array(removed), *rest], schema=schema)

    small_batches(docs.sparkSession)
    done = rows.mapInArrow(tidy(run), StructType([StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), *[StructField(c, k) for c, k in kinds.items()]]))
    more = ["n_words", "n_removed"] if counts else []
    return done.select(*[F.col("text" if c == text_col else f"c{others.index(c)}").alias(c) for c in docs.columns], *more)
