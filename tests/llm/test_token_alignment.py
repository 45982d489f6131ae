import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docloom.llm import entries, token_alignment
from docloom.llm.token_alignment import align_documents

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in plain):
        table[chr(256 + i)] = b
    return table


def plain(rows):
    """Whole texts by the libraries; every pair of tokens is compared."""
    a, b, alphabet = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    done = []
    for i, text in rows:
        links, groups, spans = [], [], ([], [])
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            ids = (e.ids, b.encode(text))
            raw = ([bytes(alphabet[c] for c in t) for t in e.tokens], [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]])
            if b"".join(raw[0]) == b"".join(raw[1]) == (" " + text).encode():
                for side in (0, 1):
                    at = 0
                    for x, t in zip(ids[side], raw[side]):
                        spans[side].append((at, at + len(t), x))
                        at += len(t)
                near = 0
                for lo, hi, x in spans[0]:
                    while spans[1][near][1] <= lo:
                        near += 1
                    k = near
                    while k < len(spans[1]) and spans[1][k][0] < hi:
                        links.append((x, spans[1][k][2]))
                        k += 1
                start = 0
                for end in sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]}):
                    groups.append("|".join(",".join(str(s[2]) for s in spans[side] if start <= s[0] < end) for side in (0, 1)) if len(text) < 3000 else None)
                    start = end
        done.append((i, spans, links, groups))
    count = Counter(p for d in done for p in d[2])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(i, len(s[0]), len(s[1]), len(g), len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), "" if not g else hashlib.sha256(";".join(g).encode()).hexdigest() if None not in g else None) for i, s, p, g in done]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:7])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want) if w[7] is not None)


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(entries.op13_tokenizer_alignment(spark, SF).select(NAMES).collect(), plain(rows))


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_all_kinds(spark, monkeypatch, seed):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 700)
    monkeypatch.setattr(token_alignment, "FAN", 3)
    monkeypatch.setattr(token_alignment, "SHARDS", 5)
    rng = random.Random(seed)
    bits = ["the", "don't", "12345", "é", "日本語", "😀", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "\x00", "\xa0", "　", " ", "\x1c", "\t", "\r\n", "\r", "\n", "\n\n", " ", "  ", "   ", "{", "}", "ﬁ", "é", "﻿", "​", "<0x41>", "a_b", "'s", "'", "-", "unrecognisable", "supercalifragilistic"]
    few = bits[:6] + ["\n", " ", "  ", "don't", "{", "'s", "unrecognisable"]
    rows = [(i, "".join(rng.choice(bits if rng.random() < 0.3 else few) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(i, b) for i, b in enumerate(bits, 500)] + [(i, f"x{b}y") for i, b in enumerate(bits, 600)] + [(i, f"x {b} y") for i, b in enumerate(bits, 700)]
    rows += [(800, None), (801, ""), (None, "no id"), (None, None), (802, "twice"), (802, "twice"), (802, "other"), (803, "ab " * 5000), (804, "z" * 4000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(4)
    same(align_documents(frame, A, B).collect(), plain(rows))


def test_empty_table_and_other_names(spark):
    frame = spark.createDataFrame([("k", "some text")], "id string, `the text` string")
    assert align_documents(frame, A, B, "the text", "id").columns == ["id", *NAMES[1:]]
    assert [r.id for r in align_documents(frame, A, B, "the text", "id").collect()] == ["k"]
    assert align_documents(frame.limit(0), A, B, "the text", "id").count() == 0
