"""Where on which page a chunk's text stands, from the words of rendered pages.

A chunk's words need not be neighbours on the page: what counts is the share of them that stands on the page in their order,
the longest common subsequence. Chunks come in document order, and each find moves the place where the next search begins,
so a document is one group: its chunks and its pages' words meet in one task, documents are spread over tasks. A chunk whose
words all stand on a page in their order is found by the places of its words alone. Else lengths are found with one long
integer a page (a bit for each of the chunk's words), and only words that the chunk has are looked at; the matched words
themselves are read off those integers on the best page alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The least share of a chunk's words, and pages searched beyond the last find or around the estimate.
LEAST, WINDOW = 0.6, 3
#: A word joins a line whose first word's top is within this share of its height.
LINE_REACH = 0.6

SIDES = ("x0", "top", "x1", "bottom")
BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
_BOX = pa.struct([(c, pa.float64()) for c in SIDES])


def token(word: Column) -> Column:
    """A word without case and punctuation."""
    return F.lower(F.regexp_replace(word, r"(?U)\W+", ""))


def chunk_tokens(content: Column, chunk_type: Column) -> Column:
    """The words of a chunk; of a table in pipes the words of its cells, without the row that parts the header."""
    lines = F.filter(F.split(content, "\n"), lambda x: ~F.trim(x).rlike(r"^\|[-:|\s]+\|$"))
    cells = F.array_join(F.transform(lines, lambda x: F.when(F.trim(x).rlike(r"(?s)^\|.*\|$"), F.translate(x, "|", " ")).otherwise(x)), "\n")
    plain = F.when(chunk_type == "table", cells).otherwise(content)
    return F.filter(F.transform(F.split(F.coalesce(plain, F.lit("")), r"(?U)\s+"), token), lambda t: t != "")


def places_of(page: list[str]) -> dict[str, list[int]]:
    """The places of each word of a page."""
    places: dict[str, list[int]] = {}
    for j, t in enumerate(page):
        if (own := places.get(t)) is None:
            places[t] = [j]
        else:
            own.append(j)
    return places


def in_order(needle: list[str], places: dict[str, list[int]]) -> list[int] | None:
    """The first places where all of the needle's words stand in their order, or None."""
    at, out = -1, []
    for t in needle:
        own = places.get(t, ())
        if (k := bisect_right(own, at)) == len(own):
            return None
        out.append(at := own[k])
    return out


def _steps(needle: list[str], page: list[str], places: dict[str, list[int]]) -> tuple[list[int], list[int]]:
    """(places of the page's words that the needle has, from the end; the needle's bits after each).

    Bit k stands for the k-th word from the needle's end, and is 0 where the common length grows there.
    """
    masks: dict[str, int] = {}
    for k, t in enumerate(reversed(needle)):
        masks[t] = masks.get(t, 0) | 1 << k
    every = (1 << len(needle)) - 1
    bits, states = every, [every]
    found = sorted(chain.from_iterable(places[t] for t in masks if t in places), reverse=True)
    for j in found:
        hit = bits & masks[page[j]]
        bits = ((bits + hit) | (bits - hit)) & every
        states.append(bits)
    return found, states


def common_length(needle: list[str], page: list[str], places: dict[str, list[int]] | None = None) -> int:
    """Length of the longest common subsequence. places: the page's, if known."""
    return len(needle) - _steps(needle, page, places_of(page) if places is None else places)[1][-1].bit_count()


def matched_places(needle: list[str], page: list[str], known: dict[str, list[int]] | None = None) -> list[int]:
    """Places on the page of a longest common subsequence: from the front, a pair of equal words is taken, else the side is
    left behind without which more is common, the needle's where both are as good. known: the places of the page's words.

    Where the page has the whole needle, the needle is never left behind, so its first places are these.
    """
    known = places_of(page) if known is None else known
    if (whole := in_order(needle, known)) is not None:
        return whole
    places, states = _steps(needle, page, known)
    n = len(needle)

    def left(i: int, s: int) -> int:
        """Common length of the needle from i on and the page from the s-th place (counted from the end) on."""
        low = (1 << (n - i)) - 1
        return n - i - (states[s] & low).bit_count()

    out, i, s = [], 0, len(places)
    while i < n and s:
        if needle[i] == page[places[s - 1]]:
            out.append(places[s - 1])
            i, s = i + 1, s - 1
        elif left(i + 1, s) >= left(i, s - 1):
            i += 1
        else:
            s -= 1
    return out


def _union(boxes: list[tuple]) -> dict:
    x0, top, x1, bottom = zip(*boxes, strict=True)
    return {"x0": min(x0), "top": min(top), "x1": max(x1), "bottom": max(bottom)}


def line_boxes(boxes: list[tuple]) -> list[dict]:
    """The boxes (x0, top, x1, bottom) united line by line."""
    lines: list[list[tuple]] = []
    for b in sorted(boxes, key=lambda b: (round(b[1], 1), b[0])):
        if lines and abs(b[1] - lines[-1][0][1]) <= LINE_REACH * max(b[3] - b[1], 1.0):
            lines[-1].append(b)
        else:
            lines.append([b])
    return [_union(x) for x in lines]


class Pages:
    """The pages of a document, numbered from 1."""

    def __init__(self, numbers: np.ndarray, tokens: list[str], boxes: np.ndarray):
        """Of words in reading order, page by page: their pages, tokens and boxes."""
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else np.zeros(0, np.int64)
        ends = [*starts[1:].tolist(), len(numbers)]
        self.spans = {int(numbers[a]): (a, b) for a, b in zip(starts.tolist(), ends, strict=False)}
        self.words, self.boxes = tokens, boxes
        self.known: dict[int, tuple[list[str], dict[str, list[int]]]] = {}
        self.last = max(self.spans, default=0)

    def page(self, number: int) -> tuple[list[str], dict[str, list[int]]]:
        """The tokens of a page and the places of each, found when it is first asked for."""
        if number not in self.known:
            a, b = self.spans[number]
            self.known[number] = self.words[a:b], places_of(self.words[a:b])
        return self.known[number]

    def best(self, needle: list[str], first: int, last: int, least: float) -> tuple[int, float, list[int]] | None:
        """(page, share, matched places) of the page from first to last with the most of the needle, the first of equals, if it has enough."""
        found, most, n, wanted = None, 0, len(needle), None
        for number in range(max(first, 1), min(last, self.last) + 1):
            if number not in self.spans:
                continue
            tokens, places = self.page(number)
            if (whole := in_order(needle, places)) is not None:
                return number, 1.0, whole
            wanted = wanted or Counter(needle)
            # No more can be common than the page has of the words at all.
            bound = sum(min(k, len(places[t])) for t, k in wanted.items() if t in places)
            if bound / n < least or bound <= most:
                continue
            common = common_length(needle, tokens, places)
            if common / n >= least and common > most:
                found, most = number, common
        return None if found is None else (found, most / n, matched_places(needle, *self.page(found)))

    def boxes_of(self, number: int, at: list[int]) -> list[tuple]:
        return [tuple(x) for x in self.boxes[self.spans[number][0] + np.array(at, np.int64)].tolist()]


def locate_chunks(chunks: DataFrame, words: DataFrame, doc: str = "doc_id", least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """What locate_on_pages finds, from words as rows: doc, page (from 1), ord, text, x0, top, x1, bottom."""
    word = F.struct("ord", "text", *SIDES)
    pages = words.groupBy(doc, "page").agg(F.array_sort(F.collect_list(word)).alias("w")).select(doc, "page", *[F.col("w")[c].alias(c) for c in ("text", *SIDES)])
    return locate_on_pages(chunks, pages, doc, least, window)


def locate_on_pages(chunks: DataFrame, pages: DataFrame, doc: str = "doc_id", least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """(doc, chunk, match_status, viewer_page, match_ratio, bbox, line_bboxes) of every chunk.

    chunks: doc, chunk (their order), block (place among the document's total_blocks, from 1), total_blocks, content and
    chunk_type; pages: a row for each, doc, page (from 1) and of its words in reading order the arrays text, x0, top, x1 and
    bottom. A chunk is searched from the page of the last find on; where that fails, around the page that its block's place
    suggests. Without words, or without a page that has enough of them, the status is failed and the rest null.
    """
    kind = chunks.schema[doc].dataType
    names = ["match_status", "viewer_page", "match_ratio", "bbox", "line_bboxes"]
    schema = pa.schema([(doc, to_arrow_type(kind)), ("chunk", pa.int64()), ("match_status", pa.string()), ("viewer_page", pa.int32()), ("match_ratio", pa.float64()), ("bbox", _BOX), ("line_bboxes", pa.list_(_BOX))])
    needles = chunks.select(F.col(f"`{doc}`").alias("doc"), F.col("chunk").cast("long").alias("chunk"), F.col("block").cast("long").alias("block"), F.col("total_blocks").cast("long").alias("total"), chunk_tokens(F.col("content"), F.col("chunk_type")).alias("tokens"))
    placed = pages.select(F.col(f"`{doc}`").alias("doc"), F.col("page").cast("int").alias("page"), F.transform("text", token).alias("token"), *[F.col(c).cast("array<double>").alias(c) for c in SIDES])

    def locate(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("page").combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(known.column("token")), 0).to_numpy()
        boxes = np.stack([pc.list_flatten(known.column(c)).to_numpy() for c in SIDES], 1)
        pages = Pages(np.repeat(known.column("page").to_numpy(), lengths), pc.list_flatten(known.column("token")).to_pylist(), boxes)
        rows, anchor = [], 1
        for row in asked.sort_by("chunk").to_pylist():
            needle, found = row["tokens"], None
            if needle:
                spans = [(anchor, min(pages.last, anchor + window))]
                guess = 1
                if row["total"] > 0 and pages.last:
                    part = max(0.0, min(1.0, (row["block"] - 1) / row["total"]))
                    guess = max(1, min(pages.last, int(part * pages.last) + 1))
                spans.append((max(1, guess - window), min(pages.last, guess + window)))
                found = next((f for f in (pages.best(needle, a, b, least) for a, b in dict.fromkeys(spans)) if f), None)
            if found is None:
                rows.append((row["doc"], row["chunk"], "failed", None, None, None, None))
                continue
            anchor, share, at = found
            own = pages.boxes_of(anchor, at)
            rows.append((row["doc"], row["chunk"], "ok", anchor, round(share, 3), _union(own), line_boxes(own)))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    found = needles.groupBy("doc").cogroup(placed.groupBy("doc")).applyInArrow(locate, f"`{doc}` {kind.simpleString()}, chunk long, match_status string, viewer_page int, match_ratio double, bbox {BOX}, line_bboxes array<{BOX}>")
    return found.select(doc, "chunk", *names)
