"""Licence scan: held-out wordings, planted lines and corner cases."""

import pytest

from docloom.llm.license_scan import scan_documents, train

PLANTED = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved."}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, docs):
    return train(docs)


def test_planted_lines(docs, model):
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in scan_documents(docs, model).collect()}
    assert set(got) == set(text)
    for i, t in text.items():
        want = {f for f, line in PLANTED.items() if line in t.split("\n")}
        assert set(filter(None, got[i].families.split(","))) == want and got[i].n_licence == sum(x in PLANTED.values() for x in t.split("\n"))
        assert got[i].n_paragraphs == sum(any(c.isalnum() for c in x) for x in t.split("\n"))


def test_wordings_and_corner_cases(spark, model):
    rows = [(1, "COPYRIGHT 2019 SOMEBODY. PERMISSION IS HEREBY GRANTED, FREE OF CHARGE, TO ANY PERSON OBTAINING A COPY OF THIS SOFTWARE"), (2, "Distributed under the terms of the Example Community License"), (3, None), (4, ""), (4, "\n"), (None, "All rights reserved."), (5, "the licence of the poet is a matter of taste " * 400)]
    got = {r.doc_id: r for r in scan_documents(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, words string"), model).collect()}
    assert got[1].family == "mit" and got[None].family == "proprietary"
    assert got[2].family in ("unknown", "none") and got[2].families == ""
    assert got[3].family == got[4].family == "none" and got[3].n_paragraphs == got[4].n_paragraphs == 0
    assert got[5].families == ""
    assert scan_documents(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
