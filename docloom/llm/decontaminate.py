"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised and cut into windows of window words; one automaton over all windows, whose
letters are the words of the items, scans each normalised text once. Normalising keeps a map of offsets, so every hit leads
to characters of the original text. Words are told apart by 64-bit hashes while scanning, and a hit is compared letter by
letter.

The items are a stated query set: each worker holds their windows and the automaton, some 500 bytes for each word of the
items, while its task runs. Their number changes nothing else: there is always one automaton and one scan.

Words: A-Z lower-cased, then runs of digits, letters and everything from U+0080. An item of fewer words than a window,
but not none, is one window. A word inside any occurrence of a window is hit.

Cases: null or empty text has no words and no hits; a very long text is scanned whole, a block by itself; items without
words match nothing; items of equal text all count; repeated rows give repeated results; an empty table of documents or
items gives no rows or no hits; extra columns are not read, or kept by clean_documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._storage import small_batches, tidy
from docloom.llm._text import ALNUM, LOWER, U64, blocks, find_words, span_hashes


def normalised_words(text: str | None) -> list[str]:
    """The words of a text; each byte of its UTF-8 form is one character."""
    data = LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
    start, end, _ = find_words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes().decode("latin-1")
    return [raw[a:b] for a, b in zip(start, end, strict=True)]


def windows(words: list[str], size: int) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Windows:
    """The windows of all items, with the items that hold each, and the automaton over them."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        import ahocorasick

        held: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            for w in windows(normalised_words(text), size):
                held.setdefault(w, set()).add(item)
        self.items = [sorted(i) for i in held.values()]
        self.texts = [" ".join(w).encode("latin-1") for w in held]
        words = sorted({x for w in held for x in w})
        data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        hashes = span_hashes(data, ends - [len(w) for w in words], ends) if words else np.zeros(0, U64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        number = {w: i + 1 for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, w in enumerate(held):
            self.automaton.add_word(tuple(number[x] for x in w), (k, len(w)))
        if held:
            self.automaton.make_automaton()

    def letters(self, h: np.ndarray) -> list[int]:
        """The automaton's letters of hashed words; 0 for a word of no item."""
        if not len(self.hashes):
            return [0] * len(h)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[place] == h, self.order[place] + 1, 0).tolist()


def scan_rows(column: pa.Array, known: Windows) -> Iterator[tuple[int, list[dict], set[str]]]:
    """For every row: its number of words, the hit runs of words, and the items found.

    A run has its first word and the word after its last, and the same as character offsets of the original text.
    """
    for lo, hi, data, offsets in blocks(column):
        low = LOWER[data]
        start, end, row = find_words(low, offsets, ALNUM)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1), "left")
        letters = known.letters(span_hashes(low, start, end))
        for i in range(hi - lo):
            a, b = int(bounds[i]), int(bounds[i + 1])
            mark = np.zeros(b - a + 1, np.int64)
            found: set[int] = set()
            if b > a and known.items:
                for e, (k, size) in known.automaton.iter(tuple(letters[a:b])):
                    first = e - size + 1
                    if b" ".join(low[start[a + j] : end[a + j]].tobytes() for j in range(first, e + 1)) == known.texts[k]:
                        found.add(k)
                        mark[first] += 1
                        mark[e + 1] -= 1
            runs = []
            if found:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]])))
                letter = np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)
                place = lambda byte: int(letter[byte - 1]) if byte else 0  # noqa: B023, E731
                base = int(offsets[i])
                runs = [{"first_word": int(s), "end_word": int(e), "start": place(int(start[a + s]) - base), "end": place(int(end[a + e - 1]) - base)} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            yield b - a, runs, {item for k in found for item in known.items[k]}


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("first_word", "end_word", "start", "end")])


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs' id with n_words, n_hit, n_items, items (ids as strings, sorted), items_sha256, contaminated, and runs (the hit places).

    One row for each row of docs, in one scan without a shuffle.
    """
    small_batches(docs.sparkSession)
    items = [(r[0], r[1]) for r in benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{item_text_col}`")).toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast(items)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("items", T.ArrayType(T.StringType()))])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("first_word", "end_word", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Windows(shared.value, size)
            rows = list(scan_rows(batch.column(1), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], run_type), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))], names=["id", "n_words", "runs", "items"])

    return source.mapInArrow(tidy(run), schema).select(
        F.col("id").alias(id_col),
        "n_words",
        F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end_word"] - r["first_word"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        "runs",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """docs, whole rows, without the contaminated ones."""
    found = find_contamination(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text")), benchmark, size, "text", "row")
    return found.filter(~F.col("contaminated")).select("row.*")
