"""Toxicity by held-out accuracy, and its corner cases."""

import numpy as np
import zlib

from docloom.llm.toxicity import label_model, reject_toxic, score_documents

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    truth = [(rows[x.doc_id].score, x.toxic) for x in labels.collect() if rows[x.doc_id].held_out]
    good, bad = [s for s, t in truth if t], [s for s, t in truth if not t]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert np.mean([(s >= 0.5) == bool(t) for s, t in truth]) > 0.9
    kept = reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("doc_id < 200")
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic")
    a, b = (sorted((r.doc_id, r.score) for r in score_documents(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_corner_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (2, "you idiot", 0.5), (None, "no id", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, labels).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1
    none = labels.limit(0)
    assert {r.score < 1e-3 for r in score_documents(docs, none).collect()} == {True}
    assert score_documents(docs.limit(0), labels).count() == 0
    assert reject_toxic(docs, none).count() == 4


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.2).astype(float)
    flip = lambda p: np.where(rng.random(2000) < p, 1 - y, y)
    good, poor = flip(0.03), (rng.random(2000) < 0.3).astype(float)
    votes = np.stack([good, good, good, flip(0.1), poor], axis=1)
    out = label_model(votes, flip(0.1))
    assert ((out["posterior"] > 0.5) == (y > 0.5)).mean() > 0.95
    assert len({*out["group"][:3].tolist()}) == 1 and out["group"][4] not in out["group"][:4]
    assert abs(out["label"][0] - 0.9) < 0.05 and abs(out["label"][1] - 0.1) < 0.05
