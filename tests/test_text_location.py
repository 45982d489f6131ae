"""Places of chunks on pages, against the plain table of common lengths."""

import random
import re

import numpy as np

from docloom.operators import text_location
from docloom.operators.text_location import common_length, line_boxes, locate_chunks, matched_places
from docloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain_match(needle, page):
    n, m = len(needle), len(page)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            table[i][j] = table[i + 1][j + 1] + 1 if needle[i] == page[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if needle[i] == page[j]:
            out, i, j = [*out, j], i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_locate(chunks, pages, total):
    """chunks: (chunk, block, tokens) in order; pages: {number: tokens}. (chunk, page, share)."""
    last, anchor, out = max(pages, default=0), 1, []
    for chunk, block, needle in chunks:
        guess = max(1, min(last, int(max(0.0, min(1.0, (block - 1) / total)) * last) + 1)) if last and total else 1
        best = None
        for a, b in ((anchor, anchor + 3), (guess - 3, guess + 3)):
            for p in range(a, b + 1):
                share = len(plain_match(needle, pages.get(p, []))) / len(needle) if needle else 0
                if share >= 0.6 and (best is None or share > best[1]):
                    best = (p, share)
            if best:
                break
        if best:
            anchor = best[0]
        out.append((chunk, *(best or (None, None))))
    return out


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(300):
        letters = "abcdefghij"[: rng.randint(1, 10)]
        needle, page = ([rng.choice(letters) for _ in range(rng.randint(1, 70))] for _ in range(2))
        want = plain_match(needle, page)
        assert matched_places(needle, page) == want
        assert common_length(needle, page) == len(want)
    assert matched_places(["a"], []) == [] and common_length(["a"], ["b"]) == 0


def test_lines():
    boxes = [(0, 10.0, 5, 20.0), (6, 10.4, 9, 20.4), (0, 22.0, 5, 32.0), (7, 15.9, 9, 26.0)]
    assert line_boxes(boxes) == [{"x0": 0, "top": 10.0, "x1": 9, "bottom": 26.0}, {"x0": 0, "top": 22.0, "x1": 5, "bottom": 32.0}]
    assert line_boxes([]) == []


def test_whole_chunks_cost_no_table_of_lengths(monkeypatch):
    rng = random.Random(7)
    page = [f"w{rng.randint(0, 300)}" for _ in range(5000)]
    needle = [w for i, w in enumerate(page[2000:2080]) if i % 6 != 5]
    want = plain_match(needle, page)

    def refuse(*_):
        raise AssertionError("looked at every word of the page")

    # Lengths were found on all pages of the window, and each looked at every word of its page.
    monkeypatch.setattr(text_location, "_steps", refuse)
    pages = text_location.Pages(np.repeat([1, 2, 3], 5000), page * 3, np.zeros((15000, 4)))
    assert pages.best(needle, 1, 3, 0.6) == (1, 1.0, want) and matched_places(needle, page) == want and len(pages.known) == 1


def words_of(doc, pages):
    return [(doc, p, i, w, float(i % 10 * 50), float(i // 10 * 14), float(i % 10 * 50 + 40), float(i // 10 * 14 + 10)) for p, text in pages.items() for i, w in enumerate(text.split())]


WORDS = "doc_id string, page int, ord int, text string, x0 double, top double, x1 double, bottom double"
CHUNKS = "doc_id string, chunk int, block int, total_blocks int, content string, chunk_type string"


def test_rules(spark):
    pages = {1: "Introduction “quoted” words about nothing", 2: "alpha beta gamma delta epsilon zeta", 3: "alpha beta gamma delta epsilon eta", 9: "far away text stands on page nine", 10: "Item Price Bolt 4.50 Nut 0.25"}
    chunks = [
        (1, 1, "quoted -- WORDS about", "text"), (2, 2, "alpha beta gamma delta epsilon", "text"), (3, 3, "alpha beta gamma delta epsilon eta", "text"), (4, 9, "far away text on page nine", "text"),
        (5, 10, "| Item | Price |\n|---|---|\n|Bolt|4.50|\n|Nut|0.25|", "table"), (6, 10, "nowhere to be found at all", "text"), (7, 10, " — ", "text"), (8, 1, "introduction quoted", "text"),
    ]
    frame = spark.createDataFrame([("d", c, b, 10, t, k) for c, b, t, k in chunks] + [("no pages", 1, 1, 1, "text", "text")], CHUNKS)
    got = {(r.doc_id, r.chunk): r for r in locate_chunks(frame, spark.createDataFrame(words_of("d", pages) + words_of("no chunks", pages), WORDS)).collect()}
    assert {k[1]: r.viewer_page for k, r in got.items() if k[0] == "d"} == {1: 1, 2: 2, 3: 3, 4: 9, 5: 10, 6: None, 7: None, 8: 1}
    assert got["d", 4].match_ratio == 1.0 and got["d", 6].match_status == "failed" and got["d", 6].bbox is None
    assert got["no pages", 1].match_status == "failed" and len(got) == 9
    box = got["d", 1].bbox
    assert (box.x0, box.top, box.x1, box.bottom) == (50.0, 0.0, 190.0, 10.0) and len(got["d", 1].line_bboxes) == 1


def test_a_thousand_pages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, chunks, want = {}, [], {}
    for doc, n in (("long", 1000), ("short", 12), ("single", 1)):
        pages = {p: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 60))) for p in range(1, n + 1)}
        docs[doc], own = pages, []
        for c in range(1, 2 * n // 5 + 2):
            words = pages[rng.randint(1, n) if c % 9 == 0 else min(n, 1 + c * 5 // 2)].split()
            at = rng.randrange(len(words) - 20)
            part = [w.upper() if rng.random() < 0.5 else w for w in words[at : at + 20] if rng.random() < 0.85] or ["none"]
            own.append((c, c, part))
            chunks.append((doc, c, c, 2 * n // 5 + 1, " ".join(part), "text"))
        want.update({(doc, c): (p, s and round(s, 3)) for c, p, s in plain_locate([(c, b, [w.lower() for w in part]) for c, b, part in own], {p: t.split() for p, t in pages.items()}, 2 * n // 5 + 1)})
    frame = spark.createDataFrame([w for d, pages in docs.items() for w in words_of(d, pages)], WORDS).repartition(3)
    got = locate_chunks(spark.createDataFrame(chunks, CHUNKS).repartition(3), frame).collect()
    assert {(r.doc_id, r.chunk): (r.viewer_page, r.match_ratio) for r in got} == want
    assert sum(p is not None for p, _ in want.values()) > 100


def test_query_by_brute_force(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    groups = {}
    for d, t in docs:
        groups.setdefault(d // 20, []).append((d, t))
    norm = lambda w: re.sub(r"\W+", "", w).lower()
    want = {}
    for g, own in groups.items():
        pages = {i + 1: [norm(w) for w in re.split(r"\s+", t.strip()) if w] for i, (_, t) in enumerate(own)}
        chunks, total = [], 0
        for d, t in own:
            words = [w for w in re.split(r"\s+", t.strip()) if w]
            for k in range(0, len(words), 80):
                total += 1
                chunks.append((d * 1000 + k // 80, total, [x for x in (norm(w) for i, w in enumerate(words[k : k + 80]) if i % 6 != 5) if x]))
        # Long pages are left to the rule's tests: the plain table is too slow for them.
        if max(map(len, pages.values())) > 700:
            continue
        want.update({(g, c): (p, s and round(s, 3)) for c, p, s in plain_locate(chunks, pages, total)})
    got = {(r.doc_id, r.chunk): (r.viewer_page, r.match_ratio) for r in registry.queries()["c17_text_location"](spark, SF).collect()}
    assert want and {k: got[k] for k in want} == want
