"""BPE encoding and decoding by forced boundaries.

Merging only ever joins neighbours into a vocabulary token, so two neighbouring symbols that stand side by side in no
vocabulary token can never end up in one: between them lies a certain cut. A text is cut at blanks, its pieces by the
tokenizer's own normaliser and pre-tokenizer, and each pre-token at its forced boundaries; the fragments are encoded on
their own and the ids concatenated. Fragments and pieces repeat, so a worker keeps the ids of those it has met in two
bounded tables (emptied when full: a matter of speed alone), which it drops with the model when its task ends.

Texts come in batches of BATCH_BYTES; a very long text is encoded whole, by itself.

Cases: null is the empty text and gives no ids; strings of added tokens inside a text are those tokens, as in the
tokenizers library; repeated rows give repeated results; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm._storage import small_batches, tidy

#: Entries of each table of a worker; about 150 bytes each, so 20 MB a table.
CACHE_ENTRIES = 130_000
#: The pre-tokenizer's pattern for which PLAIN_WORDS does the same on plain text.
PLAIN_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text of printable ASCII and Latin-1 letters needs no normaliser but lower-casing, and splits by a plain pattern.
PLAIN = re.compile("[ -~\nÀ-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-zß-öø-ÿ0-9]+")
#: The bytes above 0x7F that the byte alphabet moves to other characters.
BYTE_ALPHABET = {b: 256 + 33 + i for i, b in enumerate([*range(0x7F, 0xA1), 0xAD])}
_loaded: dict[str, ForcedBoundaryBpe] = {}


class ForcedBoundaryBpe:
    """A BPE model of the tokenizers library, with an optional end-of-word suffix, encoded fragment by fragment."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are supported")
        self.tokenizer = Tokenizer.from_file(path)
        splits = [p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if p["type"] == "Split"]
        norms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.plain = [p["pattern"] for p in splits] == [{"Regex": PLAIN_RULE}] and set(norms) == {"NFC", "Replace", "Lowercase"}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take up blanks or words are not supported")
        self.added = added
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = max([*self.vocab.values(), *added.values()]) + 1
        self.tokens: list[str] = [""] * size
        for token, i in [*self.vocab.items(), *added.items()]:
            self.tokens[i] = token
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.last_model = self.tokenizer.model
        self.inner_model = BPE(self.vocab, merges) if self.suffix else self.last_model
        self.pairs = {p for token in self.vocab for p in self._neighbours(token)}
        self.fragments: dict[str, list[int]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {"": ()}

    def _neighbours(self, token: str) -> Iterator[tuple[str, str]]:
        """Neighbouring characters (one for each byte of the text) inside a token, the end-of-word suffix aside."""
        body = token.removesuffix(self.suffix) if self.suffix else token
        return zip(body, body[1:], strict=False)

    def fragment_ids(self, fragment: str, last: bool) -> list[int]:
        """The library's merges over one fragment; only the last one of a pre-token takes the end-of-word suffix."""
        return [t.id for t in (self.last_model if last else self.inner_model).tokenize(fragment)]

    def pretoken_ids(self, pretoken: str) -> tuple[int, ...]:
        """Cut one pre-token (in the byte alphabet) at its forced boundaries and concatenate the fragments' ids."""
        pairs, n = self.pairs, len(pretoken)
        cuts = [i for i, p in enumerate(zip(pretoken, pretoken[1:], strict=False), 1) if p not in pairs]
        ids: list[int] = []
        for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
            if hi == n:
                ids += self.fragment_ids(pretoken[lo:hi], True)
                continue
            fragment = pretoken[lo:hi]
            if (known := self.fragments.get(fragment)) is None:
                if len(self.fragments) >= CACHE_ENTRIES:
                    self.fragments.clear()
                self.fragments[fragment] = known = self.fragment_ids(fragment, False)
            ids += known
        return tuple(ids)

    def word_ids(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token of plain text."""
        pretoken = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_ALPHABET)
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        self.words[word] = ids = self.pretoken_ids(pretoken)
        return ids

    def pretokens(self, part: str) -> list[str]:
        """The normaliser and the pre-tokenizer, by the library."""
        if self.tokenizer.normalizer is not None:
            part = self.tokenizer.normalizer.normalize_str(part)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)] if part else []

    def _piece_ids(self, piece: str) -> tuple[int, ...]:
        ids: list[int] = []
        for part in self.added_split.split(piece) if self.added_split else [piece]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for pretoken in self.pretokens(part):
                    ids += self.pretoken_ids(pretoken)
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces.clear()
            self.pieces[""] = ()
        self.pieces[piece] = out = tuple(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.plain and PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            known, make, units = self.words.get, self.word_ids, PLAIN_WORDS.findall(text.lower())
        else:
            # Blanks and line ends are dropped by the pre-tokenizer, and no pre-token contains one.
            known, make, units = self.pieces.get, self._piece_ids, text.replace("\n", " ").split(" ")
        return list(chain.from_iterable([make(u) if (ids := known(u)) is None else ids for u in units]))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder, special tokens kept: tokens joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, ids))


def codec(path: str) -> ForcedBoundaryBpe:
    """The tokenizer of this worker. Only for pre-tokenizers that drop white space; others are refused."""
    if path not in _loaded:
        made = ForcedBoundaryBpe(path)
        if made.tokenizer.decoder is not None or [p for p, _ in made.tokenizer.pre_tokenizer.pre_tokenize_str("a b\nc")] != ["a", "b", "c"]:
            raise ValueError("this codec needs a tokenizer that drops white space and has no decoder")
        _loaded[path] = made
    return _loaded[path]


def map_text(docs: DataFrame, columns: list[str], schema: str, make: Callable[[list], list[list]]) -> DataFrame:
    """Apply make, which takes the columns' lists of values and returns those of the result, to small slices of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(make([c.to_pylist() for c in part.columns]), arrow, strict=True)], schema=arrow)

    small_batches(docs.sparkSession)
    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(tidy(run, _loaded.clear), schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids): the token ids of every whole text."""

    def make(columns):
        c = codec(tokenizer_path)
        return [columns[0], [c.encode(t) for t in columns[1]]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>", make)


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the decoded texts of encode_documents' result."""

    def make(columns):
        c = codec(tokenizer_path)
        return [columns[0], [c.decode(i or []) for i in columns[1]]]

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_text(encoded, [id_col, "ids"], f"`{id_col}` {kind}, text string", make)


def digest_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every text, in one pass without moving ids."""

    def make(columns):
        c = codec(tokenizer_path)
        as_text = list(map(str, range(len(c.tokens))))
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        out: list[list] = [columns[0], [], [], []]
        for text in columns[1]:
            ids = c.encode(text)
            out[1].append(len(ids))
            out[2].append(sha(" ".join(map(as_text.__getitem__, ids))))
            out[3].append(sha(c.decode(ids)))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
