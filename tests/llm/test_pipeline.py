"""The pipeline's stages, each judged on its own input by brute force."""

import hashlib
import itertools

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests_llm_helpers import grams, shingles, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, tables[-1], SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_columns_and_order(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_codec"]
    assert all(t.columns == steps[0].columns for t in steps[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, steps):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    known = [(i in kept) != bool(t) for i, t in toxic.items()]
    assert sum(known) / len(known) > 0.9


def test_lines(steps):
    seen, source = set(), {r.doc_id: r.text for r in steps[1].collect()}
    got = {r.doc_id: r.text for r in steps[2].collect()}
    for i in sorted(source):
        for line in got.get(i, "").split("\n"):
            if line.count(" ") + 1 >= 20:
                assert line not in seen or line not in source[i].split("\n")
                seen.add(line)
        assert set(got.get(i, "").split("\n")) <= {*source[i].split("\n"), ""}


def test_near_copies(steps):
    docs = [(r.doc_id, shingles(r.text, 5)) for r in steps[2].collect()]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(docs, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            lo, hi = sorted((find(i), find(j)))
            root[hi] = lo
    assert {r.doc_id for r in steps[3].collect()} == {i for i in root if find(i) == i}


def test_benchmark_passages_go(spark, steps):
    items = {g for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for g in grams(r.text, 10)}
    want = {r.doc_id for r in steps[3].collect() if not any(tuple(words(r.text)[i : i + n]) in items for n in {len(g) for g in items} for i in range(len(words(r.text))))}
    assert {r.doc_id for r in steps[4].collect()} == want


def test_tokens_and_run(spark, steps):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in steps[4].collect()}
    got = {r.doc_id: r for r in steps[5].collect()}
    assert got.keys() == text.keys()
    for i, r in got.items():
        ids = lib.encode(text[i], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, got.values()))
