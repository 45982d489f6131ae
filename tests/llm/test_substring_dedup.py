import hashlib
import random

import pytest
from tests_llm_helpers import TOKEN

from docloom.llm import entries
from docloom.llm.substring_dedup import maximal_repeats, remove_repeats

SF = "/root/testdata/sf0.001"


def plain(rows, size):
    """(covered words) of each (id, text): every window compared with those of all smaller documents."""
    first = {}
    words = [TOKEN.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[a : a + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for a in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        out.append((w, gone))
    return out


def test_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for (i, _), (w, g) in zip(docs, plain(docs, 50)))
    got = sorted(tuple(r) for r in entries.op11_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert sum(r[2] > 0 for r in want) > 5


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "日本"] if seed % 2 else [f"w{i}" for i in range(60)]
    word = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [word(rng.randint(14, 60)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(-20, 60), 40):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edited"
            a = rng.randint(0, 5)
            w += word(rng.randint(0, 9)) + p[a : len(p) - rng.randint(0, 5)]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t ", "  "]) for x in w)))
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(7, "short text"), (200, ""), (201, None), (202, " \n "), (None, rows[3][1]), (None, None), (300, rows[5][1]), (300, rows[6][1]), (300, rows[6][1]), (301, "x " * 500), (302, "x " * 40), (303, "x " * 600)]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_brute_force(spark, seed):
    rows, size = corpus(seed), 14 + 3 * (seed % 3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(((i is not None, i or 0), len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for (i, _), (w, g) in zip(rows, plain(rows, size)))
    got = remove_repeats(frame, size, joined=True, counts=True).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, r.text) for r in got) == want
    cut = remove_repeats(frame, size, counts=True).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, " ".join(TOKEN.findall(r.text or ""))) for r in cut) == want
    assert {r.text for r in cut if r.doc_id == 201} == {None}
    assert [r.text for r in cut if r.doc_id == 202] == [" \n "]
    assert any(r[2] for r in want)


def test_maximal_ranges(spark):
    rows = [(i, t) for i, t in dict(corpus(2)).items() if i is not None]
    want = []
    for (i, _), (_, gone) in zip(rows, plain(rows, 20)):
        edge = [k for k in range(len(gone) + 1) if (gone[k - 1] if k else False) != (gone[k] if k < len(gone) else False)]
        want += [(i, a, b) for a, b in zip(edge[::2], edge[1::2])]
    got = maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    merged = []
    for r in sorted(map(tuple, got)):
        # Two maximal repeats may touch without a common window.
        if merged and merged[-1][0] == r[0] and merged[-1][2] == r[1]:
            merged[-1] = (r[0], merged[-1][1], r[2])
        else:
            merged.append(r)
    assert merged == sorted(want)


def test_other_columns_and_kinds_of_ids(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    frame = spark.createDataFrame([("b", f"x y {passage} z", "k", 1), ("a", passage + "\n", "l", 2), ("c", f"{passage} {passage}", None, 3)], "id string, `the text` string, `h` string, `doc` int")
    got = {r.id: tuple(r) for r in remove_repeats(frame, 20, "the text", "id").collect()}
    assert got == {"a": ("a", passage + "\n", "l", 2), "b": ("b", "x y z", "k", 1), "c": ("c", "", None, 3)}
    assert remove_repeats(frame, 20, "the text", "id").columns == frame.columns
    assert remove_repeats(frame.limit(0), 20, "the text", "id").count() == 0
    with pytest.raises(ValueError):
        remove_repeats(frame, 100, "the text", "id")
