"""Line dedup against a plain scan of all runs."""

import random

import pytest

from docloom.llm.line_dedup import dedup_lines, drop_copies


def brute(rows, min_words):
    """rows: (id, text), ids distinct. The text of each after deleting every line in a run of min_words words that stands earlier too."""
    docs = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = None if t is None else t.split("\n")
        docs.append((d, lines, [i for i, x in enumerate(lines or []) if x.strip(" ")]))
    seen, out = {}, {}
    for d, lines, full in docs:
        gone = set()
        for s in range(len(full)):
            for e in range(s, len(full)):
                body = tuple(lines[i] for i in full[s : e + 1])
                if sum(x.count(" ") + 1 for x in body) >= min_words:
                    if body in seen:
                        gone |= set(full[s : e + 1])
                    seen.setdefault(body, (d, s))
        for a, b in zip(full, full[1:], strict=False):
            if a in gone and b in gone:
                gone |= set(range(a, b))
        out[d] = None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("min_words", [6, 1])
def test_against_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    texts = ["\n".join(rng.choice([*pool, "", "  ", f"only {rng.random()}"]) for _ in range(rng.randrange(1, 14))) for _ in range(50)]
    texts += [None, "", "\n\n", "a\n" * 12, texts[0], texts[3], "one very long line " * 500, "one very long line " * 500, "\n".join(pool), "x\n" + "\n".join(pool) + "\ny"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "clash", d) for d, t in rows], "doc_id long, text string, words string, pos long").repartition(4)
    got = dedup_lines(docs, min_words, counts=True).collect()
    want = brute(rows, min_words)
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_lines_deleted == r.n_lines_before - (len(r.text.split("\n")) if r.text else 0) for r in got if r.text and r.n_lines_deleted)
    kept = drop_copies(docs, min_words)
    assert kept.columns == docs.columns
    source = dict(rows)
    assert {r.doc_id for r in kept.collect()} == {d for d, t in want.items() if t is None or t.strip(" \n") or not source[d].strip(" \n")}


def test_corner_cases(spark):
    docs = spark.createDataFrame([(None, "a b\nc"), (1, "a b\nc"), (1, "a b\nc"), (1, "c\na b\nc"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(docs, 3).collect()), key=str)
    assert got == sorted([(None, "a b\nc"), (1, ""), (1, ""), (1, "c"), (2, None)], key=str)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_names_of_other_columns_do_not_matter(spark):
    names = ["_key", "_kept", "_h", "h", "_id", "_runs", "runs", "row", "id", "kept", "c0", "odd.name", "n_lines_before"]
    rows = [(1, "a b\nc", *[f"{n}1" for n in names]), (2, "a b\nc\nd", *[f"{n}2" for n in names])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for got in (dedup_lines(docs, 3), drop_copies(docs, 3)):
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == [rows[0], (2, "d", *rows[1][2:])]
