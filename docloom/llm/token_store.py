"""Token ids as binary shards with a minimal perfect hash index.

write_token_store range-partitions documents by id and lets each task write one shard, in ascending id order: the raw ids
of its documents, one after the other, and an index from document key to the document's place in the shard. The index is
a minimal perfect hash (hash and displace: keys fall into small buckets, and each bucket stores the first displacement
that sends its keys to free slots), so a lookup reads one displacement, one slot, one length and the ids, wherever they
are; keys themselves are not stored, and the slot's fingerprint of 64 bits tells a key that is not there. A key's shard is
found from the key ranges in the manifest, one row a shard.

File of a shard: magic, header (JSON length, JSON), displacements, slots, lengths, payload, all little-endian.

Cases: null text is empty and holds the end id alone; a very long text is one payload, encoded whole; null ids come first,
as in Spark's order, and stand in no index: the header counts them; rows that repeat an id follow each other in the order
of their text, and the index leads to the first and says how many there are; an empty table gives no shards and an empty
result; extra columns are not read. A task that runs again writes the same file under another name and renames it, so lost
executors leave no half-written shard.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._storage import new_path, release, small_batches
from docloom.llm._text import mix

MAGIC = b"DLTOKST1"
#: Keys of a bucket on average; displacements tried for a bucket.
BUCKET_KEYS, MAX_DISPLACEMENT = 4, 1 << 20
#: Entries of a worker's table of encoded words; a matter of speed alone.
CACHE_ENTRIES = 700_000
SLOT = np.dtype([("fingerprint", "<u8"), ("copies", "<u4"), ("row", "<u4"), ("offset", "<u8")])

#: Pre-tokens of plain text (printable ASCII, line ends and Latin-1 letters) under the byte-level pattern.
PLAIN = re.compile("[ -~\\nÀ-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \\nA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \\n]+(?![^ \\n])|[ \\n]+")
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate([*range(0, 33), *range(0x7F, 0xA1), 0xAD])}


class ByteBpeEncoder:
    """The library's byte-level BPE, with the ids of pre-tokens kept. Text beyond plain goes to the library in whole pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule, model = spec["pre_tokenizer"], spec["model"]
        self.plain = rule["type"] == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"] and spec["normalizer"] is None and not model.get("end_of_word_suffix")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        made = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_ALPHABET))], self.kind).tobytes()
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        self.words[word] = made
        return made

    def _piece(self, piece: str) -> bytes:
        made = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()
        if len(self.pieces) >= CACHE_ENTRIES // 4:
            self.pieces.clear()
        self.pieces[piece] = made
        return made

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, as fixed-width little-endian integers."""
        if not text:
            return b""
        if self.plain and PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            known, make, units = self.words.get, self._word, PLAIN_WORDS.findall(text)
        elif self.plain and not re.search(r"\s ", text) and text[0] != " ":
            # A blank after something else than white space always begins a pre-token.
            first, *rest = text.split(" ")
            known, make, units = self.pieces.get, self._piece, [first, *[" " + r for r in rest]]
        else:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join([known(u) or make(u) for u in units])


_encoders: dict[str, ByteBpeEncoder] = {}


def encoder(path: str) -> ByteBpeEncoder:
    if path not in _encoders:
        _encoders[path] = ByteBpeEncoder(path)
    return _encoders[path]


def _open(path: str, mode: str):
    """A file of the shared folder: a local path or file: URI, or a store that Arrow's file systems reach."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at) if mode == "rb" else store.open_output_stream(at)


def _publish(path: str, content: list[bytes]) -> None:
    """Write under a name of this attempt, then rename."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    if temporary.startswith("file:") or "://" not in temporary:
        os.makedirs(os.path.dirname(re.sub("^file:/*", "/", path)), exist_ok=True)
    with _open(temporary, "wb") as f:
        for part in content:
            f.write(part)
    if temporary.startswith("file:") or "://" not in temporary:
        os.replace(re.sub("^file:/*", "/", temporary), re.sub("^file:/*", "/", path))
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(temporary)
        store.move(at, fs.FileSystem.from_uri(path)[1])


def _key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    """Of the key alone, and independent of its hash."""
    return mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return mix(h ^ (displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(max(n, 1))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key) of a minimal perfect hash of distinct integer keys."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    h = _key_hash(keys)
    bucket = (h >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    displacement, slot, taken = np.zeros(buckets, "<u4"), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):
        mine = order[bounds[b] : bounds[b + 1]]
        if not len(mine):
            break
        step, width = 0, 64
        while step < MAX_DISPLACEMENT:
            tries = np.arange(step, step + width, dtype=np.uint64)
            places = _slots(h[mine][None, :], tries[:, None], n).astype(np.int64)
            good = ~taken[places].any(axis=1)
            if len(mine) > 1:
                s = np.sort(places, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                displacement[b], slot[mine] = step + k, places[k]
                taken[places[k]] = True
                break
            step, width = step + width, min(width * 2, 4096)
        else:
            raise ValueError("no displacement found; use smaller shards")
    return displacement, slot


def shard_bytes(ids: list[int | None], payloads: list[bytes], kind: np.dtype) -> list[bytes]:
    """The parts of a shard's file. ids: ascending, null first; a repeated id's rows follow each other."""
    tokens = np.array([len(p) // kind.itemsize for p in payloads], np.int64)
    nulls = sum(i is None for i in ids)
    keys = np.array(ids[nulls:], np.int64)
    distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
    displacement, slot = build_index(distinct)
    table = np.zeros(len(distinct), SLOT)
    starts = np.cumsum(tokens) - tokens
    at = first + nulls
    table["fingerprint"][slot] = _fingerprint(distinct)
    table["copies"][slot], table["row"][slot], table["offset"][slot] = copies, at, starts[at]
    header = json.dumps({"dtype": kind.str, "rows": len(ids), "nulls": nulls, "keys": len(distinct), "buckets": len(displacement), "tokens": int(tokens.sum())}).encode()
    return [MAGIC, len(header).to_bytes(4, "little"), header, displacement.tobytes(), table.tobytes(), tokens.astype("<u8").tobytes(), *payloads]


class Shard:
    """A shard's file, open for keyed access. index: keep displacements, slots and lengths in memory, for many keys."""

    def __init__(self, file, index: bool = False):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(file.read(4), "little")
        self.head = h = json.loads(file.read(size))
        self.kind = np.dtype(h["dtype"])
        self.at_slots = 12 + size + 4 * h["buckets"]
        self.at_lengths = self.at_slots + SLOT.itemsize * h["keys"]
        self.at_ids = self.at_lengths + 8 * h["rows"]
        self.at_displacements = 12 + size
        self.index = None
        if index:
            self.index = self._read(self.at_displacements, h["buckets"], "<u4"), self._read(self.at_slots, h["keys"], SLOT), self._read(self.at_lengths, h["rows"], "<u8")

    def _read(self, at: int, n: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, by displacement; copies is 0 where the stored fingerprint differs."""
        n = self.head["keys"]
        if not n or not len(keys):
            return np.zeros(len(keys), SLOT)
        h = _key_hash(keys)
        bucket = ((h >> np.uint64(33)) % np.uint64(self.head["buckets"])).astype(np.int64)
        if self.index is not None:
            found = self.index[1][_slots(h, self.index[0][bucket], n).astype(np.int64)]
        else:
            moved = np.concatenate([self._read(self.at_displacements + 4 * b, 1, "<u4") for b in bucket.tolist()])
            found = np.concatenate([self._read(self.at_slots + SLOT.itemsize * s, 1, SLOT) for s in _slots(h, moved, n).astype(np.int64).tolist()])
        found = found.copy()
        found["copies"][found["fingerprint"] != _fingerprint(keys)] = 0
        return found

    def rows(self, first: int, n: int) -> np.ndarray:
        """The numbers of ids of n rows."""
        return (self.index[2][first : first + n] if self.index is not None else self._read(self.at_lengths + 8 * first, n, "<u8")).astype(np.int64)

    def ids(self, offset: int, n: int) -> np.ndarray:
        return self._read(self.at_ids + self.kind.itemsize * offset, n, self.kind)

    def documents(self, slot: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(offset, ids) of each document of a found key."""
        lengths = self.rows(int(slot["row"]), int(slot["copies"]))
        offsets = int(slot["offset"]) + np.cumsum(lengths) - lengths
        return [(o, self.ids(o, n)) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of a key's documents, read in constant time; none where the key isn't there."""
        slot = self.find(np.array([key], np.int64))[0]
        return [ids for _, ids in self.documents(slot)] if slot["copies"] else []


MANIFEST = "shard int, path string, first_key long, last_key long, n_docs long, n_ids long"


def write_token_store(docs: DataFrame, tokenizer_path: str, directory: str | None = None, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the shards of docs into directory (by default a new one in the shared folder) and return the manifest, one row a shard with the number of ids in the shards before it."""
    spark = docs.sparkSession
    directory = directory or new_path(spark, "tokens")
    small_batches(spark)
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(tokenizer_path)
        end = np.array([end_id], e.kind).tobytes()
        ids: list[int | None] = []
        payloads: list[bytes] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, 256):
                payloads += [e.encode(t) + end for t in batch.column(1).slice(lo, 256).to_pylist()]
        if ids:
            shard = TaskContext.get().partitionId()
            path = f"{directory}/shard-{shard:06d}.tok"
            _publish(path, shard_bytes(ids, payloads, e.kind))
            known = [i for i in ids if i is not None] or [None]
            row = {"shard": [shard], "path": [path], "first_key": [known[0]], "last_key": [known[-1]], "n_docs": [len(ids)], "n_ids": [sum(map(len, payloads)) // e.kind.itemsize]}
            payloads.clear()
            release()
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # A shard is what one task sorts: about the session's advisory partition size of text.
    made = source.repartitionByRange("_id").sortWithinPartitions("_id", "_text").mapInArrow(write, MANIFEST)
    path = f"{directory}/manifest"
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _routed(manifest: DataFrame, keys: DataFrame, key_col: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    """((shard, key) of the wanted keys, path and number of ids before of every shard). One row a shard comes to the driver.

    A key goes to the last shard that begins at or before it; a null key to the first shard.
    """
    shards = sorted((r["shard"], r["path"], r["first_key"], r["n_ids"]) for r in manifest.collect())
    before = np.cumsum([0, *[s[3] for s in shards]]).tolist()
    # A shard of null ids alone has no first key: it begins before all others.
    cuts = np.array([np.iinfo(np.int64).min if s[2] is None else s[2] for s in shards], np.int64)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(cuts, key.fillna(0).to_numpy().astype(np.int64), "right") - 1, 0)
        return pd.Series(np.where(key.isna().to_numpy(), 0, at), dtype="int32")

    wanted = keys.select(F.col(f"`{key_col}`").cast("long").alias("key")).distinct()
    if not shards:
        return wanted.select(F.lit(0).alias("shard"), "key"), []
    return wanted.select(shard_of("key").alias("shard"), "key"), list(zip([s[1] for s in shards], before, strict=False))


def read_token_store(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document with one of the keys, read through the shards' indexes.

    start counts the ids of all documents before it: those of the shards before, from the manifest, and the slot's offset.
    """
    wanted, shards = _routed(manifest, keys, key_col)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if shards:
            path, base = shards[table.column("shard")[0].as_py()]
            with _open(path, "rb") as f:
                shard = Shard(f, index=True)
                known = np.sort(table.column("key").drop_null().to_numpy().astype(np.int64))
                found = shard.find(known)
                documents = [(k, o, ids) for k, slot in zip(known.tolist(), found, strict=True) if slot["copies"] for o, ids in shard.documents(slot)]
                if table.column("key").null_count:
                    lengths = shard.rows(0, shard.head["nulls"])
                    documents += [(None, o, shard.ids(o, n)) for o, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True)]
                rows = [(k, base + o, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, o, ids in documents]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    return wanted.groupBy("shard").applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, copy, ids) of the wanted keys, a row for each of a key's documents; copy 0 and null ids where it is absent.

    Each key costs four small reads at its place in its shard.
    """
    wanted, shards = _routed(manifest, keys, key_col)
    wanted = wanted.filter("key is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number in np.unique(batch.column(0).to_numpy()).tolist():
                mine = batch.column(1).filter(pa.compute.equal(batch.column(0), number)).to_pylist()
                if not shards:
                    rows += [(key, 0, None) for key in mine]
                    continue
                with _open(shards[number][0], "rb") as f:
                    shard = Shard(f)
                    for key in mine:
                        got = shard.get(key)
                        rows += [(key, i + 1, ids.astype(np.int64).tolist()) for i, ids in enumerate(got)] or [(key, 0, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["key", "copy", "ids"])

    return wanted.mapInArrow(find, "key long, copy int, ids array<long>")
