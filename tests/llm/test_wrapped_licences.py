"""Licence notices wrapped over lines, and the sample of ordinary lines."""

import pytest

from docloom.llm import license_scan
from docloom.llm.license_scan import TEMPLATES, _examples, _ordinary, scan_documents, train

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived
   from this software without specific prior written permission.
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def wrap(text, width):
    lines = [""]
    for w in text.split():
        lines = [*lines[:-1], f"{lines[-1]} {w}".strip()] if len(lines[-1]) + len(w) < width else [*lines, w]
    return "\n".join(lines)


def test_wrapped_notices(spark, docs):
    model = train(docs)
    mit = wrap(TEMPLATES["mit"][1], 30)
    plain = "the river runs to the sea\nand the boats go\nby the bank"
    rows = [(1, BSD), (2, f"{plain}\n{mit}\n{plain}"), (3, plain), (4, f"{plain}\n\nReleased under the MIT License.\n{plain}"), (4, mit)]
    got = {r.doc_id: r for r in scan_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].family == "bsd-3-clause" and "bsd-3-clause" in got[1].families.split(",")
    assert got[2].family == "mit" and got[2].families == "mit" and got[2].n_paragraphs == 6 + len(mit.split("\n"))
    assert got[3].family == "none" and got[3].n_licence == 0
    assert got[4].families == "mit"


def test_a_hot_line_is_one_ordinary_line(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "NEGATIVES", 20)
    rows = [(i, f"hot\nplain{i}") for i in range(300)]
    found = _examples(_ordinary(spark.createDataFrame(rows, "doc_id long, text string"), "text")).filter("label = 0").collect()
    want = sorted({x for _, t in rows for x in t.split("\n")})
    lows = spark.createDataFrame([(x,) for x in want], "line string").selectExpr("line").orderBy(license_scan.F.xxhash64("line"), "line").limit(20).collect()
    assert sorted(r.words[0] for r in found) == sorted(r.line for r in lows)
