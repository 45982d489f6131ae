"""No line is passed over: the scan of documents agrees with classifying each of their lines, whatever words are frequent."""

import time

from pyspark.sql import functions as F

from docloom.llm.license_scan import classify, scan_documents, train, windows, words

SF = "/root/testdata/sf0.001"


def test_frequent_words_of_notices(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    # Lines of which each holds a word of a notice make these words as frequent as any.
    often = spark.range(3000).select((F.col("id") + 100_000).alias("doc_id"), F.concat(F.element_at(F.array(F.lit("all"), F.lit("rights"), F.lit("reserved")), (F.col("id") % 3 + 1).cast("int")), F.lit(" of item "), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([(900_001, "All rights reserved."), (900_002, "Permission is hereby granted\n\nAll rights reserved."), (900_003, None), (900_004, " \n ")], "doc_id long, text string")
    corpus = docs.unionByName(often).unionByName(asked).cache()
    model = train(corpus)
    got = {r.doc_id: r for r in scan_documents(corpus, model).collect()}
    lines = corpus.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", words(F.col("line")).alias("words")).filter(F.size("words") > 0)
    seen = classify(lines, model).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("family") != "none").alias("licence"), F.count_if(F.col("family") == "unknown").alias("unknown")).collect()
    assert {r.doc_id: r.n for r in seen} == {k: r.n_paragraphs for k, r in got.items() if r.n_paragraphs}
    # Windows of wrapped notices may add to the lines' licences, never take any.
    assert all(got[r.doc_id].n_licence >= r.licence and got[r.doc_id].n_unknown == r.unknown for r in seen)
    assert got[900_001].n_licence == 1 and got[900_001].family != "none"
    assert got[900_003].n_paragraphs == got[900_004].n_paragraphs == 0
    corpus.unpersist()


def test_probabilities_are_left_out_only_where_they_say_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = train(docs)
    rows = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(words(F.col("line")).alias("words")).filter(F.size("words") > 0)
    from docloom.llm.license_scan import softmax

    both = model.probabilities(rows).join(model.scores(rows).select("words", softmax(F.col("raw"), model.temperature)[0].alias("none")).distinct(), "words")
    assert both.filter("p is null").count() > 0
    assert both.filter("p is null and none < 0.5").count() == 0


def test_required_words_lose_no_window(spark):
    from docloom.llm.license_scan import TEMPLATES, _own, needed

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = train(docs)
    for t in [t for ts in TEMPLATES.values() for t in ts]:
        # Without the required words fewer than needed() of a template's words are left.
        assert len(set(_own(t)) - set(model.required)) < needed(t)
    wrapped = spark.createDataFrame([(i + 10**6, "\n".join(" ".join(t.split()[k : k + 4]) for k in range(0, len(t.split()), 4))) for i, t in enumerate(t for ts in TEMPLATES.values() for t in ts)], "doc_id long, text string")
    both = docs.unionByName(wrapped)
    rows = lambda df: sorted((r.doc_id, r.block, tuple(r.words)) for r in df.collect())
    found = rows(windows(both, "text", "doc_id", model.required))
    assert found == rows(windows(both, "text", "doc_id")) and found


def test_windows_are_linear(spark):
    # Every line has words of notices, so no block is dropped before its windows are made.
    line = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    took = []
    for n in (1000, 4000):
        docs = spark.createDataFrame([(1, "\n".join(f"{line} {i}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        windows(docs, "text", "doc_id").write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 5
