"""Decontamination, fingerprints, token store and BPE codec against brute force."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from docloom.llm.bpe_codec import decode_documents, digest_documents, encode_documents
from docloom.llm.decontaminate import clean_documents, find_contamination
from docloom.llm.syncmer import anchors, as_text, compare_with_next, fingerprint_documents, from_text, likeness, sketch
from docloom.llm.token_store import lookup, read_token_store, write_token_store

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD_TEXTS = [
    None,
    "",
    " ",
    "a",
    "a<|endoftext|>b <|startoftext|>",
    "it's 'tis don't I'LL we'd",
    " x y\x1cz\x85q  two  blanks \n line\n\n",
    "éá b ́c",
    "ΑΣ Σ ΣΑ İI ß K",
    "日本語テキスト 한국어",
    "12345 3.14 x2y",
    "\t\ta\r\nb \t c",
    "😀👍🏽 ok",
    "a\x00b",
    "%%%***### foo&&&",
    "﻿x",
    "x" * 3000,
    "ﬁ ǅ ½ ² Ⅷ œuvre „quote“",
    " a   b　",
]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    odd = [Row(doc_id=10_000 + i, text=t) for i, t in enumerate(ODD_TEXTS)]
    return [*docs, *odd, Row(doc_id=10_003, text="a second row of an id"), Row(doc_id=10_003, text="a second row of an id"), Row(doc_id=None, text="no id")]


@pytest.fixture(scope="module")
def frame(spark, corpus):
    rows = [(r.doc_id, r.text, "clash") for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(5)


def brute_contamination(corpus, items, size):
    found = {}
    wins = {}
    for item, text in items:
        w = WORD.findall(low(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    for r in corpus:
        w = WORD.findall(low(r.text))
        hit, got = set(), set()
        for width in {len(x) for x in wins}:
            for i in range(len(w) - width + 1):
                if (key := tuple(w[i : i + width])) in wins:
                    hit |= set(range(i, i + width))
                    got |= wins[key]
        found.setdefault((r.doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)), 0)
        found[(r.doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))] += 1
    return found


def test_contamination(spark, frame, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "x2y"), (901, None), (902, "..."), (11, corpus[7].text), (903, "second row OF")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(frame, bench, 10)
    got = {}
    for r in found.collect():
        key = (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        got[key] = got.get(key, 0) + 1
        assert sum(x.end_word - x.first_word for x in r.runs) == r.n_hit
    assert got == brute_contamination(corpus, items, 10)
    assert sum(k[-1] for k in got) > 3
    text = {r.doc_id: r.text for r in corpus}
    for r in found.filter("contaminated and doc_id < 10000").collect():
        for x in r.runs:
            assert len(WORD.findall(low(text[r.doc_id][x.start : x.end]))) == x.end_word - x.first_word
    dotted = frame.withColumnRenamed("n_words", "odd.name")
    assert clean_documents(dotted, bench, 10).columns == dotted.columns
    clean = clean_documents(frame, bench, 10)
    assert clean.columns == frame.columns
    assert clean.count() == found.filter("not contaminated").count()


def test_contamination_of_nothing(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(frame, none).filter("contaminated").count() == 0
    assert find_contamination(frame.limit(0), none).count() == 0


def test_one_automaton_at_any_size_and_words_of_equal_hash(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from docloom.llm import decontaminate

    many = decontaminate.Windows([(str(i), f"a{i} b{i} c{i} d{i % 7}") for i in range(5000)], 3)
    rows = list(decontaminate.scan_rows(pa.array(["x B17 c17 d3 y", "b17 c17 d4"]), many))
    assert rows == [(5, [{"first_word": 1, "end_word": 4, "start": 2, "end": 12}], {"17"}), (3, [], set())]
    # Even if all words had one hash, only equal ones would be hit.
    monkeypatch.setattr(decontaminate, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    few = decontaminate.Windows([("i", "one one one")], 3)
    assert [r[2] for r in decontaminate.scan_rows(pa.array(["one one two", "one one one"]), few)] == [set(), {"i"}]


def plain_syncmers(text, k, s, value):
    """Where the smallest value of an inner s-mer, the leftmost of equals, stands first or last in the k-mer."""
    found = []
    for i in range(len(text) - k + 1):
        inner = [value(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if inner.index(min(inner)) in (0, k - s):
            found.append(i)
    return found


def test_syncmers_against_a_plain_form():
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde é漢😀"[: rng.randrange(1, 10)]) for _ in range(rng.randrange(12, 200))) for _ in range(60)]
    known: dict[str, int] = {}
    for t in texts:
        for k, s in ((12, 5), (8, 3)):
            value = lambda x: known.setdefault(x, int(anchors(x, len(x), len(x))[1][0]))
            at, h = anchors(t, k, s)
            assert at.tolist() == plain_syncmers(t, k, s, value)
            assert h.tolist() == [value(t[i : i + k]) for i in at]
            places = {}
            for i, x in zip(at.tolist(), h.tolist(), strict=True):
                assert places.setdefault(x, t[i : i + k]) == t[i : i + k]


def test_sketch_and_likeness_against_sets():
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    for n in (0, 3, 50, 200):
        a, b = " ".join(base[:n]), " ".join(base[100:])
        x, y = ({v >> 32 for v in anchors(t)[1].tolist()} for t in (a, b))
        assert from_text(as_text(sketch(a))).tolist() == sorted(x)[:64]
        least = set(sorted(x | y)[:64])
        assert likeness(sketch(a), sketch(b)) == len(least & x & y) / len(least)


def test_syncmers_depend_on_their_own_letters_alone():
    a = "the quick brown fox jumps over the lazy dog and runs away from it"
    _, h = anchors(a)
    _, h2 = anchors("something else before: " + a + " and after")
    assert set(h) <= set(h2)
    assert len(h) < len(a) / 2


def test_fingerprints(spark, frame, corpus):
    got = {}
    for r in compare_with_next(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(corpus)
    order = sorted(corpus, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    for here, nxt in zip(order, [*order[1:], order[0]], strict=True):
        text, other = here.text or "", nxt.text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(sketch(text)), as_text(sketch(edited)), likeness(sketch(text), sketch(edited)), likeness(sketch(text), sketch(other)))
        assert want in [tuple(r)[1:] for r in got[here.doc_id]]
    plain = {(r.doc_id, r.fingerprint) for r in fingerprint_documents(frame).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for rs in got.values() for r in rs}
    assert compare_with_next(frame.limit(0)).count() == 0
    one = compare_with_next(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0


def test_likeness_estimates_jaccard():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    x, y = set(anchors(a)[1]), set(anchors(b)[1])
    assert abs(likeness(sketch(a), sketch(b)) - len(x & y) / len(x | y)) < 0.2
    assert likeness(from_text(as_text(sketch(a))), sketch(a)) == 1.0


def test_token_store(spark, frame, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    manifest = write_token_store(frame, path)
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_store(manifest, frame).collect()]
    start, want, ids_of = 0, [], {}
    for r in sorted(corpus, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        ids_of.setdefault(r.doc_id, []).append(ids)
        want.append((r.doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(rows, key=lambda x: x[1]) == want
    keys = spark.createDataFrame([(0,), (7,), (10_003,), (10_005,), (555_555,), (5_000,), (None,)], "doc_id long")
    found = {}
    for r in sorted(lookup(spark, manifest, keys).collect(), key=lambda r: (r.key, r.copy)):
        found.setdefault(r.key, []).append(r.ids)
    assert found == {0: ids_of[0], 7: ids_of[7], 10_003: ids_of[10_003], 10_005: ids_of[10_005], 555_555: [None], 5_000: [None]}
    assert len(found[10_003]) == 3
    some = read_token_store(manifest, keys.filter("doc_id in (7, 5000)")).collect()
    assert [tuple(r) for r in some] == [w for w in want if w[0] == 7]
    assert read_token_store(write_token_store(frame.limit(0), path), frame).count() == 0


def test_an_index_fault_shows(tmp_path):
    import numpy as np

    from docloom.llm.token_store import Shard, shard_bytes

    keys = [None, *range(-50, 400, 3), 1 << 60]
    content = b"".join(shard_bytes(keys, [np.arange(i % 5, dtype="<u2").tobytes() for i in range(len(keys))], np.dtype("<u2")))
    (tmp_path / "s").write_bytes(content)
    for index in (False, True):
        with open(tmp_path / "s", "rb") as f:
            shard = Shard(f, index)
            assert all([x.tolist() for x in shard.get(k)] == [list(range(i % 5))] for i, k in enumerate(keys) if k is not None)
            assert not any(shard.get(k) for k in (-49, 401, 1 << 61))
    broken = bytearray(content)
    broken[shard.at_slots : shard.at_lengths] = bytes(shard.at_lengths - shard.at_slots)
    (tmp_path / "b").write_bytes(broken)
    with open(tmp_path / "b", "rb") as f:
        shard = Shard(f)
        assert not any(shard.get(k) for k in keys if k is not None)


def test_bpe_codec(spark, frame, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for r in corpus:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, digest_documents(frame, path).collect()), key=key) == sorted(want, key=key)
    encoded = encode_documents(frame, path)
    decoded = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in decode_documents(encoded, path).collect()}
    assert decoded == {(w[0], w[3]) for w in want}
    assert digest_documents(frame.limit(0), path).count() == 0
