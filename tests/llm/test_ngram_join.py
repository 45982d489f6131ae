"""The n-gram Jaccard join against all pairs by brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import Row

from docloom.llm.components import components
from docloom.llm.ngram_join import keep_one_of_each, link_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, part, whole):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and whole * len(a & b) >= part * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(rng, base, n, rate):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(max(1, int(len(w) * rate))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,part", [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, part, monkeypatch):
    monkeypatch.setattr("docloom.llm.count_join.BLOCK_BYTES", 60_000)
    monkeypatch.setattr("docloom.llm.count_join.RANGE_BYTES", 40_000)
    monkeypatch.setattr("docloom.llm.ngram_join.SMALL_GROUP", 8)
    rng = random.Random(k)
    texts = [None, "", " \n ", "One", "one", "one TWO", "ONE two", "one two three four", "x" * 5000, "é É", "a\x00b a", "a b a"]
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts += family(rng, base, 30, 0.015) + family(rng, base, 20, 0.03) + [" ".join(base)] * 15 + [" ".join(base).upper()]
    for size in (10, 30, 60, 150):
        b = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(b), " ".join(b[:-1]), " ".join(b + ["tail"]), *family(rng, b, 4, 0.01)]
    # A chain: each is close to the next, the ends are not.
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i : i + 150]) for i in range(0, 50, 2)]
    texts += ["the same passage in all of these " * 3 + " ".join(f"u{rng.randrange(10**6)}" for _ in range(n)) for n in (1, 2, 3, 5, 8, 20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(5, "one two three four"), (5, "one two three four"), (None, " ".join(chain[:150])), (None, "nothing like it"), (None, None)]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()[:80]]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, e string, n int").repartition(6)
    got = link_documents(docs, k, part, 100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, part, 100)
    kept = keep_one_of_each(docs.filter("doc_id <> 5"), k, part, 100)
    assert kept.columns == docs.columns
    want = {r[0] for r in brute([r for r in rows if r[0] not in (5, None)], k, part, 100) if r[0] == r[2]}
    assert {r.doc_id for r in kept.collect()} == want


def test_each_pair_is_met_once_and_links_with_the_suffix_filter(spark, monkeypatch):
    from docloom.llm import ngram_join

    tables = []
    plain = ngram_join._verify
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, *a: tables.append(pairs.select("a", "b").collect()) or plain(pairs, *a))
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = [t for r in (0.01, 0.03, 0.06) for t in family(rng, base, 24, r)]
    # A chain, whose ends are unlike: one comparison with a pivot doesn't connect it.
    texts += [" ".join(f"c{j}" for j in range(i, i + 150)) for i in range(0, 80, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = link_documents(docs, 3, 90, 100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(list(enumerate(texts)), 3, 90, 100)
    met = [(r.a, r.b) for rows in tables for r in rows]
    assert len(tables) > 1 and len(met) == len(set(met)) and all(a < b for a, b in met)


def test_the_suffix_filter_never_drops_a_link():
    import numpy as np

    from docloom.llm.ngram_join import passes_suffix_filter, similar

    rng = np.random.default_rng(2)
    stopped = 0
    for _ in range(400):
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 80))).astype(np.uint64)
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.5, 0.9, 0.98, 1])], rng.integers(0, 1 << 60, rng.integers(0, 8)).astype(np.uint64)]))
        for v in np.intersect1d(x, y)[:5]:
            ok = passes_suffix_filter(x, y, int(np.searchsorted(x, v)), int(np.searchsorted(y, v)), 80, 100)
            assert ok or not similar(x, y, 80, 100)
            stopped += not ok
    assert stopped > 20


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert link_documents(docs).count() == 0
    assert keep_one_of_each(docs).count() == 0
    assert link_documents(spark.createDataFrame([Row(doc_id=1, text=None)], "doc_id long, text string")).collect() == [Row(doc_id=1, n_shingles=0, component_id=1)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found, n = components(spark.createDataFrame(pairs, "a long, b long"))
    got = {r.node: r.root for r in found.collect()}
    assert n == len(got)
    assert got == {x: find(x) for x in root if x != find(x)}
