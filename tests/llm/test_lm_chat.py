"""LM scoring and chat rotation against brute force."""

import math
import re
from collections import Counter

import pytest

from docloom.llm.backoff_lm import score_documents
from docloom.llm.chat_format import render, rotate_perspectives

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order, monkeypatch):
    monkeypatch.setattr("docloom.llm.count_join.BLOCK_BYTES", 2000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    rows += [(900, None), (901, ""), (902, "..."), (903, "one"), (903, "one"), (None, "One TWO one two éé"), (904, "the " * 3000)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, block string").repartition(3)
    words = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    counts = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(order + 1)]
    total = sum(map(len, words))
    want = []
    for (d, _), w in zip(rows, words, strict=True):
        score = alone = 0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += round(1e6 * math.log(0.4 ** (longest - 1) * counts[1][g])) - round(1e6 * math.log(total))
                    alone += 1
                elif counts[n][g] >= 2:
                    score += round(1e6 * math.log(0.4 ** (longest - n) * (counts[n][g] / counts[n - 1][g[:-1]])))
                    break
        want.append((d, len(w), alone, score))
    got = [(r.doc_id, r.n_words, r.n_unigram, r.log_score_micro) for r in score_documents(docs, order).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert all(abs(a[3] - b[3]) <= a[1] for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    assert score_documents(docs.limit(0), order).count() == 0


def test_rotation(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "x" * 5000), (2, 0, "system", "alone"), (None, 5, "eve", "?"), (3, 1, None, "who"), (3, 1, "zed", "b"), (3, 1, "zed", "a"), (3, None, "zed", "first")]
    turns += [(4, i, f"p{i % 3}", f"t{i}") for i in range(300)]
    rotated = rotate_perspectives(spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, label string"))
    got = {(r.conv_id, r.perspective): r for r in render(rotated).collect()}
    want = {}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or ""))
        for who in {t[2] for t in mine} - {"system", None}:
            text, spans = "", []
            for _, _, role, said in mine:
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={role or 'unknown'}|>\n"
                start = len(text)
                text += (said or "") + "\n<|end|>\n"
                if role == who:
                    spans.append((start, len(text)))
            want[conv, who] = (text, spans)
    assert {k: (r.text, [tuple(s) for s in r.spans]) for k, r in got.items()} == want
    assert rotate_perspectives(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
