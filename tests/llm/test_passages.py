"""Positional matching of anchors: shared passages against brute force."""

import random

import numpy as np

from docloom.llm import entries, syncmer
from docloom.llm.syncmer import K, Anchors, anchors, compare_with_next, edited_anchors, jaccard, likeness, placed, shared_passages, sketch


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * 17) % 99991}x{seed}" for i in range(n))


PASSAGE = prose(5, 50)
LONG, OTHER = prose(1, 9000) + " " + PASSAGE + " " + prose(2, 9000), prose(3, 8000) + " " + PASSAGE + " " + prose(4, 8000)


def test_a_short_passage_of_long_texts_is_placed(spark):
    assert likeness(sketch(LONG), sketch(OTHER)) == 0.0
    start, other, length = max(placed(anchors(LONG), anchors(OTHER)).tolist(), key=lambda p: p[2])
    assert LONG[start : start + length] == OTHER[other : other + length]
    assert length > len(PASSAGE) - 2 * K and PASSAGE[K:-K] in LONG[start : start + length]
    assert jaccard(anchors(LONG)[1], anchors(OTHER)[1]) > 0
    docs = spark.createDataFrame([(2, LONG), (1, OTHER)], "doc_id long, text string")
    row = next(r for r in compare_with_next(docs, passages=True).collect() if r.doc_id == 2)
    assert row.near_next == 0.0 and (row.longest_start_next, row.longest_other_start_next, row.longest_chars_next) == (start, other, length)


def test_passages_are_equal_and_cover_all_shared_anchors():
    texts = ["x" * 3000, "x" * 2000 + "y" * 50, "the cat sat on the mat " * 90, "a " + "the cat sat on the mat " * 40 + PASSAGE, PASSAGE, "", "short"]
    for a in texts:
        for b in texts:
            if min(len(a), len(b)) < K:
                continue
            (at, h), theirs = anchors(a), anchors(b)
            found = placed((at, h), theirs).tolist()
            assert all(a[s : s + n] == b[o : o + n] for s, o, n in found)
            shared = {p for p, x in zip(at.tolist(), h.tolist(), strict=True) if x in set(theirs[1].tolist())}
            assert all(any(s <= p and p + K <= s + n for s, _, n in found) for p in shared)
            if a == b:
                assert len(found) == 1 and found[0][0] == found[0][1]


def test_shared_passages_of_a_table(spark):
    rows = [(1, PASSAGE + prose(6, 40)), (2, prose(7, 30) + PASSAGE), (3, prose(8, 60)), (4, prose(9, 5) + PASSAGE + prose(9, 20)), (5, None), (6, ""), (None, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for i, a in rows:
        for j, b in rows:
            if i and j and i < j and a and b:
                by = {}
                (at, h), (bt, g) = anchors(a), anchors(b)
                for p, x in zip(at.tolist(), h.tolist(), strict=True):
                    for q, y in zip(bt.tolist(), g.tolist(), strict=True):
                        if x == y:
                            by.setdefault(q - p, []).append(p)
                for d, ps in by.items():
                    run = [ps[0]]
                    for p in [*ps[1:], 1 << 40]:
                        if p - run[-1] > K:
                            want.add((i, j, run[0], run[0] + d, run[-1] - run[0] + K))
                            run = []
                        run.append(p)
    assert {(1, 2), (1, 4), (2, 4)} <= {w[:2] for w in want}
    for hot in (1000, 1):
        assert {tuple(r) for r in shared_passages(docs, hot=hot).collect()} == want


def test_anchors_of_an_edited_text_come_from_both_texts(monkeypatch):
    rng = random.Random(4)
    texts = ["", "a", "x" * 200, LONG, OTHER, *["".join(rng.choice(["ab ", "cd", "é", "f"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]]
    for text, following in [(LONG, OTHER), *[(rng.choice(texts), rng.choice(texts)) for _ in range(2000)]]:
        cut, taken = len(text) - len(text) // 2, min(len(text) // 2, len(following))
        got, want = edited_anchors(text, anchors(text), cut, following, anchors(following), taken), anchors(text[:cut] + following[:taken])
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
        assert Anchors(*want).smallest().tolist() == sketch(text[:cut] + following[:taken]).tolist()
    # Every text is read once; the edited one was read anew.
    mine, theirs, read = anchors(LONG), anchors(OTHER), []
    monkeypatch.setattr(syncmer, "anchors", lambda text, k=K, plain=anchors: read.append(len(text)) or plain(text, k))
    syncmer._row((0, 1, LONG, Anchors(*mine)), OTHER, Anchors(*theirs), True)
    assert sum(read) < 2 * K and np.array_equal(mine[1], anchors(LONG)[1])


def test_the_query_places_passages(spark):
    got = entries.queries()["op7_document_fingerprints"](spark, "/root/testdata/sf0.001")
    rows = got.collect()
    assert all(r.shared_chars_edited >= r.n_chars // 2 - K for r in rows if r.n_chars >= 4 * K)
