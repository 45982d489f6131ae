"""Page layout: folds over the words of one page, whose order matters. A page is a bounded group; pages are spread over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: float
    top: float
    x1: float
    bottom: float


class Line(NamedTuple):
    text: str
    size: float
    top: float
    bottom: float


def per_page(rows: DataFrame, page: str, order: str, fold: Callable[[list[Box]], list[int | None]], name: str) -> DataFrame:
    """(page, order, name): fold gives a number for each box of a page, or null, which drops it. rows: page, order, x0, top, x1, bottom.

    A page's boxes come as one array, so many pages share a batch.
    """
    packed = F.array_sort(F.collect_list(F.struct(order, "x0", "top", "x1", "bottom")))
    pages = rows.groupBy(page).agg(packed.alias("w"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for at, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = fold([Box(w["x0"], w["top"], w["x1"], w["bottom"]) for w in words])
                out += [(at, w[order], v) for w, v in zip(words, values, strict=True) if v is not None]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, batch.schema.field(1).type.value_type.field(0).type), pa.array(c, pa.int32())], names=[page, order, name])

    return pages.mapInArrow(run, f"`{page}` {kinds[page]}, `{order}` {kinds[order]}, `{name}` int")


def line_numbers(words: list[Box]) -> list[int]:
    """Lines of words in reading order (x0, x1, top, bottom): a new one where the top leaves the line's first word by 0.6 of its height, or the gap to the word before exceeds four heights (30 at least)."""
    out, line, first, before = [], -1, None, None
    for w in words:
        height = first.bottom - first.top if first is not None else 0
        if first is None or abs(w.top - first.top) > 0.6 * height or w.x0 - before.x1 > max(4 * height, 30):
            line, first = line + 1, w
        out.append(line)
        before = w
    return out


def row_bands(words: list[Box]) -> list[int]:
    """The first band whose first word's top is within 0.65 of the median height, else a new one."""
    reach = 0.65 * median(w.bottom - w.top for w in words)
    tops: list[float] = []
    out = []
    for _, top, _, _ in words:
        at = next((i for i, t in enumerate(tops) if abs(t - top) <= reach), len(tops))
        if at == len(tops):
            tops.append(top)
        out.append(at)
    return out


def paragraphs(lines: list[Line]) -> list[tuple[str, str, str]]:
    """Lines (text, size, top, bottom) as paragraphs with section and subsection.

    A line of 1.85 times the body size and 14 words at most is a section, of 1.15 times and 20 words a subsection; headings
    that follow each other are one; a gap of 1.35 median heights begins a paragraph.
    """
    body = median(w.size for w in lines)
    gap = 1.35 * median(w.bottom - w.top for w in lines)
    section = subsection = ""
    kind_before, out, before = "", [], None
    for w in lines:
        n = len(w.text.split())
        kind = "section" if w.size >= 1.85 * body and n <= 14 else "subsection" if w.size >= 1.15 * body and n <= 20 else "text"
        if kind == "section":
            section = f"{section} {w.text}".strip() if kind_before == kind else w.text
            subsection = ""
        elif kind == "subsection":
            subsection = f"{subsection} {w.text}".strip() if kind_before == kind else w.text
        elif kind_before == "text" and w.top - before.bottom <= gap:
            out[-1][2] += " " + w.text
        else:
            out.append([section, subsection, w.text])
        kind_before, before = kind, w
    return [tuple(p) for p in out]


def clusters(rows: list[Box], reach: float = 8.0) -> list[int]:
    """Boxes that meet when each is widened by reach are one cluster."""
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i].x0)
    live: list[int] = []
    for i in order:
        live = [j for j in live if rows[j].x1 + 2 * reach >= rows[i].x0]
        for j in live:
            if rows[j].top - reach <= rows[i].bottom + reach and rows[i].top - reach <= rows[j].bottom + reach:
                root[find(i)] = find(j)
        live.append(i)
    names: dict[int, int] = {}
    return [names.setdefault(find(i), len(names)) for i in range(len(rows))]


def keep_apart(rows: list[Box], most_iou: float = 0.6, limit: int = 2) -> list[int]:
    """Places of boxes taken greedily in their order, none over another by more than most_iou."""
    kept: list[int] = []
    for i, a in enumerate(rows):
        if len(kept) == limit:
            break
        for j in kept:
            b = rows[j]
            w, h = max(0, min(a.x1, b.x1) - max(a.x0, b.x0)), max(0, min(a.bottom, b.bottom) - max(a.top, b.top))
            union = (a.x1 - a.x0) * (a.bottom - a.top) + (b.x1 - b.x0) * (b.bottom - b.top) - w * h
            if union > 0 and w * h / union > most_iou:
                break
        else:
            kept.append(i)
    return kept


def lcs_share(needle: list[str], hay: list[str]) -> float:
    """Longest common subsequence of words, as a share of the needle."""
    row = [0] * (len(hay) + 1)
    for x in needle:
        diagonal = 0
        for j, y in enumerate(hay, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / len(needle) if needle else 0.0


def locate(chunks: list[list[str]], pages: list[list[str]], least: float = 0.6, ahead: int = 3) -> list[int | None]:
    """The page of each chunk, the first of the next few from the last find that holds least of its words in order."""
    at, out = 0, []
    for words in chunks:
        found = next((p for p in range(at, min(at + ahead + 1, len(pages))) if lcs_share(words, pages[p]) >= least), None)
        at = at if found is None else found
        out.append(found)
    return out


def merge_label_rows(rows: list[list[str]]) -> list[list[str]]:
    """Rows with a label alone go into the row of values that follows; trailing ones into the last."""
    out: list[list[str]] = []
    waiting: list[str] = []
    for row in rows:
        if any(c.strip() for c in row[1:]):
            out.append([" ".join([*waiting, row[0]]).strip(), *row[1:]])
            waiting = []
        else:
            waiting.append(row[0])
    if waiting and out:
        out[-1][0] = " ".join([out[-1][0], *waiting]).strip()
    return out
