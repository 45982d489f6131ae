"""Counts of hashed items over all documents, joined back to the documents that hold them.

Documents are dealt into blocks of some megabytes. A block explodes its texts into hashed items, sums them, and sends each
hash partition its distinct items with their counts: one sorted array for each partition, not a row for each item. A
partition adds up the counts of all blocks, which is its part of the count table, joins the table back to each block's
items, and returns the totals in the block's order. However frequent an item, it is one entry of a block's array, so a hot
one costs a partition no more than the number of blocks. The texts are shuffled once; both sides of the last join read
that shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._storage import release
from docloom.llm._text import U64

#: Bytes of text of a block, and bytes of text whose items a hash range takes, on average. What a task holds follows from
#: them, whatever the size of the table; each block sends each range one row, so give larger executors larger ones.
BLOCK_BYTES, RANGE_BYTES = 8_000_000, 16_000_000


def pack(h: np.ndarray) -> bytes:
    """Ascending numbers as their differences, each in as many bytes as the largest needs."""
    d = h.copy()
    d[1:] -= h[:-1]
    width = max(1, -(-int(d[1:].max(initial=0)).bit_length() // 8))
    return bytes([width]) + h[:1].tobytes() + d[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(b: bytes) -> np.ndarray:
    if len(b) == 1:
        return np.zeros(0, U64)
    rest = np.frombuffer(b, np.uint8, offset=9).reshape(-1, b[0])
    d = np.zeros((len(rest) + 1, 8), np.uint8)
    d[1:, : b[0]] = rest
    d[0] = np.frombuffer(b, np.uint8, 8, 1)
    return np.cumsum(d.view("<u8").reshape(-1).astype(U64))


def pack_counts(counts: np.ndarray) -> bytes:
    """Byte planes, compressed: most counts are small."""
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(b: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def deal(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, int]:
    """((doc_id, text, block), bytes of text): a block's rows in one partition."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block"), size


def with_counts(dealt: DataFrame, size: int, explode: Callable[[pa.Table], list[np.ndarray]], finish: Callable[[pa.Table, list[np.ndarray]], pa.Table], schema: str, bits: int = 64) -> DataFrame:
    """finish(block, totals) of every block, as rows of schema.

    explode: a block's hashes, an array for each kind of item, with repeats. totals: for each kind the counts over all
    blocks of the block's distinct hashes in ascending order. bits: how many of a hash's upper bits tell items apart.
    """
    sent = pa.schema([("part", pa.int32()), ("from", pa.int32()), ("kind", pa.int32()), ("items", pa.binary()), ("counts", pa.binary())])
    answered = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary())])
    parts = max(1, -(-size // RANGE_BYTES))

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows: list[tuple] = []
        for kind, items in enumerate(explode(table)):
            items >>= U64(64 - bits)
            items.sort()
            first = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, np.int64)
            c = np.diff(np.append(first, len(items)))
            items = items[first]
            edges = np.searchsorted(((items >> U64(bits - 32)) * U64(parts)) >> U64(32), np.arange(parts + 1, dtype=U64))
            rows += [(p, block, kind, pack(items[a:b]), pack_counts(c[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        release()
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(sent)], schema=sent)

    def add(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())
        done = []
        for kind in np.unique(kinds):
            mine = table.filter(pa.array(kinds == kind))
            packed = mine.column("items").to_pylist()
            known = np.concatenate([unpack(b) for b in packed])
            known.sort()
            known = known[np.append(True, known[1:] != known[:-1])]
            total = np.zeros(len(known), np.int64)
            for b, c in zip(packed, mine.column("counts").to_pylist(), strict=True):
                total[np.searchsorted(known, unpack(b))] += unpack_counts(c)
            replies = [pack_counts(total[np.searchsorted(known, unpack(b))]) for b in packed]
            done.append(pa.Table.from_arrays([mine.column("from").combine_chunks(), mine.column("part").combine_chunks(), mine.column("kind").combine_chunks(), pa.array(replies, pa.binary())], schema=answered))
        release()
        return pa.concat_tables(done)

    def close(texts: pa.Table, replies: pa.Table) -> pa.Table:
        answers = sorted(zip(replies.column("kind").to_pylist(), replies.column("part").to_pylist(), replies.column("counts").to_pylist(), strict=True))
        kinds = 1 + max((a[0] for a in answers), default=-1)
        out = finish(texts, [np.concatenate([unpack_counts(c) for k, _, c in answers if k == kind] or [np.zeros(0, np.int64)]) for kind in range(kinds)])
        release()
        return out

    requests = dealt.groupBy("block").applyInArrow(send, "part int, from int, kind int, items binary, counts binary")
    tables = requests.repartition(parts, "part").groupBy("part").applyInArrow(add, "block int, part int, kind int, counts binary")
    return dealt.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(close, schema)
