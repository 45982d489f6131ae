"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) stand for the same bytes.

Both tokenize a blank and the text. Token ends are byte offsets; where both end, a group ends; an A and a B token that
overlap are linked. Over all documents every linked pair of ids is counted, and a document reports the counts of its links.

Counting. Documents are dealt into blocks. A block sums its links by pair and sends each shard of pairs (all pairs of a B id
are in one) one sorted table. Unions of these tables, made group by group up a tree, give a shard's distinct pairs, and a
minimal perfect hash gives each of them a place. Then tables become dense count vectors indexed by place, which are summed
up a tree of the same fan-in, so no task ever holds the tables of more than FAN blocks. Places are verified: each stores
its pair. In a second pass blocks look up their pairs, again FAN blocks at a time, align their documents anew and sum up.

Units. A text is cut before blanks and line ends that follow something else than white space. Pre-tokens of A never go
across such a place and no piece of B does (checked on the vocabulary), so units are tokenized on their own, each distinct
one of a block once. A text with other white space or U+2581, for which that isn't shown, is one unit.

Cases: null and empty texts, and those whose tokens do not give back a blank and the text (U+2581 in a text becomes a
blank), have no tokens: zeros and an empty digest; a very long text is a row of units, or one unit, and is aligned whole;
strings of special tokens are plain text; repeated rows count as often as they stand there, and repeat in the result; an
empty table gives an empty table; ids are returned as they are, null too; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.llm._storage import discard, release, staged
from docloom.llm._text import U64
from docloom.llm.count_join import pack, pack_counts, unpack, unpack_counts
from docloom.llm.token_store import _key_hash, _slots, build_index

#: Bytes of text of a block; tables that a task of the trees takes; shards of the pairs, of which the vocabularies allow
#: no more than |A| * |B| at any size of the corpus; units that are tokenized together; length of a unit from which on the
#: library that takes long ones in its stride tokenizes.
BLOCK_BYTES, FAN, SHARDS, CHUNK, LONG = 8_000_000, 64, 64, 2_000, 500
#: The byte-level pre-tokenizer's pattern, a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

UNIT = re.compile(r"\s*\S+|\s+")
#: White space other than blank and line end, and the sign that B has for a blank.
UNCUT = re.compile("[^\\S \n]|▁")
#: What a whole text begins with: no other unit has a blank before something else than white space.
WHOLE = " W"


class Tokenizers:
    """The two tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        alphabet |= {chr(256 + i): b for i, b in enumerate([*range(33), *range(127, 161), 173])}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet.get(c, 0) for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        # Pieces have a blank only at their start, after blanks, and no line end: those places are certain cuts.
        self.cuts = not any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces) and self.b.encode("\n")[:1] == [self.blank]
        self.ranked = self._ranked(a_path)
        a, b = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        #: An id as text after each sign: an A token that begins a unit, begins a group, goes on; a B token that begins, goes on.
        self.shown = [*a, *[";" + x for x in a], *["," + x for x in a], *["|" + x for x in b], *["," + x for x in b]]
        self.shown_size = np.array([len(x) for x in self.shown], np.int64)

    def _ranked(self, path: str):
        """tiktoken's encoder of the same tokens, where ids stand in the order of merges: then both merge alike, and this one is faster."""
        from tiktoken import Encoding

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule["add_prefix_space"] and spec["normalizer"] is None
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or model["type"] != "BPE" or odd:
            return None
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][t] for t in made]
        if ids != sorted(set(ids)) or len(model["vocab"]) - len([t for t in spec["added_tokens"] if t["content"] in model["vocab"]]) != len(made) + 256:
            return None
        ranks = {self.a_bytes[i]: i for t, i in model["vocab"].items() if t not in {x["content"] for x in spec["added_tokens"]}}
        return Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def units_of(self, text: str | None) -> list[str]:
        """The units of a text: one after a blank goes without it, others (after a line end, after more white space, whole texts) begin with white space."""
        if not text:
            return []
        if not self.cuts:
            return [WHOLE + text]
        units = text.replace("\n", " \n").split(" ")
        if "" in units or "\n" in units:
            # Runs of white space, or some at either end.
            units = [u[1:] if u[0] == " " and len(u) > 1 and u[1] not in " \n" else u for u in UNIT.findall(" " + text)]
        return units

    def raw(self, units: list[str]) -> str:
        """The text that units stand for, one after the other; of a whole text with its blank."""
        if " " in units[0]:
            return " " + units[0][len(WHOLE) :] if units[0].startswith(WHOLE) else units[0]
        return (" " + " ".join(units)).replace(" \n", "\n")

    def chunks(self, units: list[str]) -> list[list[str]]:
        """Units one after the other that are tokenized together; those with a blank, and those that end in white space, by themselves."""
        out: list[list[str]] = []
        lo = 0
        for i, u in enumerate(units):
            if " " in u or u[-1] == "\n":
                out += [units[k : min(k + CHUNK, i)] for k in range(lo, i, CHUNK)] + [[u]]
                lo = i + 1
        return out + [units[k : k + CHUNK] for k in range(lo, len(units), CHUNK)]

    def tokens(self, chunks: list[list[str]]) -> tuple[list[list[int]], list[list[int]]]:
        """(A ids, B ids) of each chunk. B puts a blank before what it gets: it replaces the first one, or is dropped before a line end."""
        texts = [self.raw(c) for c in chunks]
        a: list = [None] * len(texts)
        if self.ranked is not None:
            for i, c in enumerate(chunks):
                if max(map(len, c)) <= LONG:
                    a[i] = self.ranked.encode_ordinary(texts[i])
        rest = [i for i, ids in enumerate(a) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            a[i] = e.ids
        b = self.b.encode([t if t[0] == "\n" else t[1:] for t in texts], num_threads=1)
        return a, [[self.blank] if t == " " else ids[1:] if t[0] == "\n" else ids for t, ids in zip(texts, b, strict=True)]

    def faithful(self, chunk: list[str], a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == self.raw(chunk).encode() == b"".join(map(self.b_bytes.__getitem__, b))


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


class Block:
    """The documents of a block as units, and each distinct unit aligned.

    Tokens of all units lie on one line of bytes, so an overlap of an A and a B token is a stretch between two neighbouring
    ends of either kind: one link for each end.
    """

    def __init__(self, known: Tokenizers, texts: list[str | None]):
        number: dict[str, int] = defaultdict(count().__next__)
        rows = [list(map(number.__getitem__, known.units_of(t))) for t in texts]
        # Texts with signs for which the cuts aren't shown are taken whole.
        odd = {i for u, i in number.items() if UNCUT.search(u) and not u.startswith(WHOLE)}
        if odd:
            rows = [[number[WHOLE + t]] if not odd.isdisjoint(r) else r for t, r in zip(texts, rows, strict=True)]
        units = list(number)
        if odd:
            units = self._renumber(rows, units)
        chunks = known.chunks(units)
        a, b = known.tokens(chunks)
        good = [known.faithful(*x) for x in zip(chunks, a, b, strict=True)]
        if not all(good):
            # Those of a chunk that isn't given back are looked at one by one.
            again = [u for c, g in zip(chunks, good, strict=True) if not g for u in c]
            a, b = known.tokens([[u] for u in again])
            lost = {u for u, x, y in zip(again, a, b, strict=True) if not known.faithful([u], x, y)}
            rows = [[] if any(units[i] in lost for i in r) else r for r in rows]
            units = self._renumber(rows, units)
            chunks = known.chunks(units)
            a, b = known.tokens(chunks)
            if not all(known.faithful(*x) for x in zip(chunks, a, b, strict=True)):
                raise RuntimeError("units are not given back together as they are one by one")
        self.known, self.n_units = known, len(units)
        lengths = np.array([len(r) for r in rows], np.int64)
        self.row_ends = np.cumsum(lengths)
        self.flat = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        self.a_end, self.b_end = np.cumsum(known.a_size[self.a]), np.cumsum(known.b_size[self.b])
        size = np.array([len(u) if u.isascii() else len(u.encode()) for u in units], np.int64)
        # With the blank that most go without; a whole text's mark stands for its blank.
        size += np.array([1 - len(WHOLE) if u.startswith(WHOLE) else u[0] not in " \n" for u in units], np.int64)
        unit_end = np.cumsum(size)
        n = int(unit_end[-1]) if len(units) else 0
        at_a, at_b, at_unit = (self._marks(x, n) for x in (self.a_end, self.b_end, unit_end))
        ends = np.flatnonzero(at_a | at_b)
        self.group_end = np.flatnonzero(at_a & at_b)
        if (at_unit & ~(at_a & at_b)).any():
            raise RuntimeError("a unit ends within a token")
        self.before_unit, self.before_group = self._before(at_unit), self._before(at_a & at_b)
        self.pairs = self.a[self._before(at_a)[ends]] << 32 | self.b[self._before(at_b)[ends]]
        self.owner = self.before_unit[ends]

    @staticmethod
    def _renumber(rows: list[list[int]], units: list[str]) -> list[str]:
        """The units that rows still have; rows get their new numbers."""
        place: dict[int, int] = defaultdict(count().__next__)
        for k, r in enumerate(rows):
            rows[k] = [place[i] for i in r]
        return [units[i] for i in place]

    @staticmethod
    def _marks(ends: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n + 1, bool)
        out[ends] = True
        return out

    @staticmethod
    def _before(marks: np.ndarray) -> np.ndarray:
        """How many marks stand before each place."""
        return np.cumsum(marks, dtype=np.int32) - marks

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs, ascending; how many links of the block hold each)."""
        times = np.bincount(self.flat, minlength=self.n_units)
        distinct, at = np.unique(self.pairs, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, times[self.owner])
        return distinct, total

    def texts(self) -> list[str]:
        """The groups of each unit."""
        a_group, b_group = self.before_group[self.a_end], self.before_group[self.b_end]
        n_a, n_b = len(self.known.a_bytes), len(self.known.b_bytes)
        a_unit, b_unit = self.before_unit[self.a_end], self.before_unit[self.b_end]
        new = lambda x: np.append(True, x[1:] != x[:-1])[: len(x)]
        codes = np.concatenate([self.a + n_a * np.where(new(a_unit), 0, np.where(new(a_group), 1, 2)), self.b + 3 * n_a + n_b * np.where(new(b_group), 0, 1)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        codes = codes[order]
        every = "".join(map(self.known.shown.__getitem__, codes.tolist()))
        tokens = np.bincount(a_unit, minlength=self.n_units) + np.bincount(b_unit, minlength=self.n_units)
        at = np.append(0, np.cumsum(self.known.shown_size[codes]))[np.cumsum(tokens)].tolist()
        return [every[lo:hi] for lo, hi in zip([0, *at], at, strict=False)]

    def report(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> list[list]:
        """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document. pairs: ascending, with corpus counts."""
        at = np.minimum(np.searchsorted(pairs, self.pairs), max(len(pairs) - 1, 0))
        if len(self.pairs) and (not len(pairs) or (pairs[at] != self.pairs).any()):
            raise RuntimeError("a pair has no count")
        each = [np.bincount(self.before_unit[x], minlength=self.n_units) for x in (self.a_end, self.b_end, self.group_end)]
        each.append(np.bincount(self.owner, minlength=self.n_units))
        for values in (best, counts):
            sums = np.zeros(self.n_units, np.int64)
            if len(self.pairs):
                np.add.at(sums, self.owner, values[at])
            each.append(sums)
        begins = np.append(0, self.row_ends)[:-1]
        out = []
        for values in each:
            sums = np.append(0, np.cumsum(values[self.flat]))
            out.append((sums[self.row_ends] - sums[begins]).tolist())
        text, flat = self.texts(), self.flat.tolist()
        out.append([hashlib.sha256(";".join(map(text.__getitem__, flat[lo:hi])).encode()).hexdigest() if hi > lo else "" for lo, hi in zip(begins.tolist(), self.row_ends.tolist(), strict=True)])
        return out


def _shard_of(pairs: np.ndarray) -> np.ndarray:
    return (_key_hash(pairs & 0xFFFFFFFF) >> U64(40)).astype(np.int64) % SHARDS


def _places(pairs: np.ndarray, displacement: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each pair in its shard, verified."""
    h = _key_hash(pairs)
    moved = displacement[((h >> U64(33)) % U64(len(displacement))).astype(np.int64)]
    at = _slots(h, moved, len(keys)).astype(np.int64)
    if (keys[at] != pairs).any():
        raise RuntimeError("a pair is not the one that its place stores")
    return at


def _climb(tables: DataFrame, groups: int, merge, schema: str) -> DataFrame:
    """One row a shard, merged FAN at a time. tables: (shard, grp, ...) with grp below groups."""
    while groups > 1:
        tables = tables.withColumn("grp", F.floor(F.col("grp") / FAN).cast("int")).groupBy("shard", "grp").applyInArrow(merge, schema)
        groups = -(-groups // FAN)
    return tables


def count_pairs(tables: DataFrame, blocks: int) -> DataFrame:
    """Staged (shard, displacement, keys, counts, best): one row a shard; counts and best by place. tables: (block, shard, pairs, counts)."""
    first = -(-blocks // FAN)
    grouped = tables.select("shard", F.floor(F.col("block") / FAN).cast("int").alias("grp"), "pairs", "counts")

    def row(table: pa.Table, **values) -> pa.Table:
        out = {"shard": [table.column("shard")[0].as_py()], **{k: [v] for k, v in values.items()}}
        release()
        return pa.Table.from_pydict(out, schema=pa.schema([(k, pa.int32() if k in ("shard", "grp") else pa.binary()) for k in out]))

    def unite(table: pa.Table) -> pa.Table:
        pairs = np.unique(np.concatenate([unpack(b) for b in table.column("pairs").to_pylist()]))
        return row(table, grp=table.column("grp")[0].as_py(), pairs=pack(pairs))

    def index(table: pa.Table) -> pa.Table:
        pairs = np.concatenate([unpack(b) for b in table.column("pairs").to_pylist()]).view(np.int64)
        displacement, slot = build_index(pairs)
        keys = np.zeros(len(pairs), "<i8")
        keys[slot] = pairs
        return row(table, displacement=displacement.astype("<u4").tobytes(), keys=keys.tobytes())

    unions = grouped.select("shard", "grp", "pairs").groupBy("shard", "grp").applyInArrow(unite, "shard int, grp int, pairs binary")
    distinct = _climb(unions, first, unite, "shard int, grp int, pairs binary")
    hashed = staged(distinct.groupBy("shard").applyInArrow(index, "shard int, displacement binary, keys binary"), "pair-hash", free=True)

    def dense(table: pa.Table, places: pa.Table) -> pa.Table:
        displacement, keys = (np.frombuffer(places.column(c)[0].as_py(), k) for c, k in (("displacement", "<u4"), ("keys", "<i8")))
        vector = np.zeros(len(keys), np.int64)
        for pairs, counts in zip(table.column("pairs").to_pylist(), table.column("counts").to_pylist(), strict=True):
            vector[_places(unpack(pairs).view(np.int64), displacement, keys)] += unpack_counts(counts)
        return row(table, grp=table.column("grp")[0].as_py(), vector=pack_counts(vector)) if table.num_rows else empty

    empty = pa.table({"shard": pa.array([], pa.int32()), "grp": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        vector = None
        for b in table.column("vector").to_pylist():
            v = unpack_counts(b)
            vector = v if vector is None else vector + v
        return row(table, grp=table.column("grp")[0].as_py(), vector=pack_counts(vector))

    each = hashed.select("*", F.explode(F.sequence(F.lit(0), F.lit(first - 1))).alias("grp"))
    vectors = grouped.groupBy("shard", "grp").cogroup(each.groupBy("shard", "grp")).applyInArrow(dense, "shard int, grp int, vector binary")
    sums = _climb(vectors, first, add, "shard int, grp int, vector binary")

    def finish(table: pa.Table) -> pa.Table:
        keys, counts = np.frombuffer(table.column("keys")[0].as_py(), "<i8"), unpack_counts(table.column("vector")[0].as_py())
        b, of = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        most = np.zeros(len(b), np.int64)
        np.maximum.at(most, of, counts)
        return row(table, displacement=table.column("displacement")[0].as_py(), keys=keys.tobytes(), counts=counts.astype("<i8").tobytes(), best=np.packbits(counts == most[of]).tobytes())

    done = hashed.join(sums, "shard").select("shard", "displacement", "keys", "vector").groupBy("shard").applyInArrow(finish, "shard int, displacement binary, keys binary, counts binary, best binary")
    out = staged(done, "pair-counts", free=True)
    discard(hashed)
    return out


def align_documents(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    text, kind = F.col(f"`{text_col}`"), docs.schema[id_col].dataType
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    sent = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])

    def send(table: pa.Table) -> pa.Table:
        pairs, counts = Block(tokenizers_of(a_path, b_path), table.column("text").to_pylist()).counts()
        shard = _shard_of(pairs)
        rows = [(s, pack(pairs[shard == s].astype(U64)), pack_counts(counts[shard == s])) for s in np.unique(shard).tolist()]
        block = table.column("block")[0].as_py()
        release()
        return pa.Table.from_arrays([pa.array([block] * len(rows), pa.int32()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(list(sent.types)[1:])]], schema=sent)

    tables = staged(dealt.groupBy("block").applyInArrow(send, "block int, shard int, pairs binary, counts binary"), "pairs", free=True)
    model = count_pairs(tables, blocks)

    answered = pa.schema([("block", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows:
            displacement, keys, counts = (np.frombuffer(known.column(c)[0].as_py(), k) for c, k in (("displacement", "<u4"), ("keys", "<i8"), ("counts", "<i8")))
            best = np.unpackbits(np.frombuffer(known.column("best")[0].as_py(), np.uint8))
            for block, pairs in zip(asked.column("block").to_pylist(), asked.column("pairs").to_pylist(), strict=True):
                at = _places(unpack(pairs).view(np.int64), displacement, keys)
                rows.append((block, pairs, pack_counts(counts[at]), np.packbits(best[at]).tobytes()))
        release()
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(answered.types)], schema=answered)

    asked = tables.select("block", "shard", F.floor(F.col("block") / FAN).cast("int").alias("grp"), "pairs")
    each = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-blocks // FAN) - 1))).alias("grp"))
    replies = asked.groupBy("shard", "grp").cogroup(each.groupBy("shard", "grp")).applyInArrow(answer, "block int, pairs binary, counts binary, best binary")
    replies = staged(replies, "replies", free=True)
    discard(tables, model)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = pa.schema([(id_col, to_arrow_type(kind)), *[(n, pa.int64()) for n in numbers], ("groups_sha256", pa.string())])

    def close(texts: pa.Table, known: pa.Table) -> pa.Table:
        block = Block(tokenizers_of(a_path, b_path), texts.column("text").to_pylist())
        parts = [(unpack(p).view(np.int64), unpack_counts(c)) for p, c in zip(known.column("pairs").to_pylist(), known.column("counts").to_pylist(), strict=True)]
        best = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p[0])) for b, p in zip(known.column("best").to_pylist(), parts, strict=True)]
        none = np.zeros(0, np.int64)
        pairs = np.concatenate([none, *[p for p, _ in parts]])
        order = np.argsort(pairs)
        columns = block.report(pairs[order], np.concatenate([none, *[c for _, c in parts]])[order], np.concatenate([none, *best]).astype(np.int64)[order])
        out = pa.Table.from_arrays([texts.column("id").combine_chunks().cast(schema[0].type), *[pa.array(c, t) for c, t in zip(columns, list(schema.types)[1:], strict=True)]], schema=schema)
        release()
        return out

    result = StructType([StructField(id_col, kind), *[StructField(n, LongType()) for n in numbers], StructField("groups_sha256", StringType())])
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(close, result)
