"""Ingestion by batches that count at once, and the machine of documents' states."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.sources.batch_log import BatchLog
from docloom.streaming import ingestion
from docloom.streaming.states import DocumentState, state_stream


def files(spark, *named):
    return spark.createDataFrame([(f"file:/in/{u}/{d}", t.encode()) for u, d, t in named], "path string, content binary")


def tables(log):
    names = {"chunks": ["user_id", "doc_id", "ord", "content", "chunk_id"], "digests": ["user_id", "doc_id", "digest"], "states": ["user_id", "doc_id", "status", "progress", "message", "chunk_count", "error"]}
    return {n: sorted(map(tuple, log.read(n).select(*c).collect()), key=str) for n, c in names.items() if log.read(n) is not None}


def test_batches(spark, tmp_path, monkeypatch):
    log = BatchLog(spark, str(tmp_path / "tables"))
    assert log.read("chunks") is None and log.committed() == []
    first = files(spark, ("u1", "a.txt", " ".join(f"w{i}" for i in range(500))), ("u2", "a.txt", "the words of u2"), ("u1", "empty.md", " "), ("u1", "x.pdf", "%PDF"))
    ingestion.ingest_batch(first, log, 0)
    before = tables(log)
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in before["states"]] == [("u1", "a.txt", "indexed", 2, None), ("u1", "empty.md", "failed", 0, ingestion.NO_TEXT), ("u1", "x.pdf", "failed", 0, "Unsupported document format: .pdf"), ("u2", "a.txt", "indexed", 1, None)]
    assert len(before["chunks"]) == 3 and [d[2] for d in before["digests"]] == ["File: a.txt (txt)\nSize: 1 pages\nChunk types: text=2", "File: a.txt (txt)\nSize: 1 pages\nChunk types: text=1"]
    assert log.read("chunks").filter(F.size("embedding") == 64).count() == 3
    # A batch that runs twice changes nothing.
    ingestion.ingest_batch(first, log, 0)
    assert tables(log) == before
    # One that dies half-way changes nothing either, and makes up for it when it runs again.
    second = files(spark, ("u1", "a.txt", "a shorter text"), ("u3", "b.txt", "new"))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingestion.library, "digests", die)
        with pytest.raises(RuntimeError):
            ingestion.ingest_batch(second, log, 1)
    assert tables(log) == before
    ingestion.ingest_batch(second, log, 1)
    after = tables(log)
    assert sorted((r[0], r[1], r[3]) for r in after["chunks"]) == [("u1", "a.txt", "a shorter text"), ("u2", "a.txt", "the words of u2"), ("u3", "b.txt", "new")]
    assert len(after["states"]) == 5
    # Only the batch's own folders were written.
    assert sorted(p.name for p in (tmp_path / "tables" / "chunks").iterdir()) == ["batch=0", "batch=1"]
    # Deleting is a batch without rows; compaction leaves the same rows in one batch.
    log.replace(spark.createDataFrame([("u2", "a.txt"), ("nobody", "x")], "user_id string, doc_id string"), 2)
    log.commit(2)
    left = tables(log)
    assert not [r for r in left["chunks"] if r[0] == "u2"]
    log.compact(["chunks", "digests", "states"], 3)
    assert tables(log) == left and log.committed() == [3]
    assert log.read("chunks", spark.createDataFrame([("u3", "b.txt")], "user_id string, doc_id string")).count() == 1


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in" / "u1").mkdir(parents=True)
    for n in range(2):
        (tmp_path / "in" / "u1" / f"d{n}.txt").write_text(f"text {n}")
        assert ingestion.start_batches(spark, str(tmp_path / "in"), str(tmp_path / "tables"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    log = BatchLog(spark, str(tmp_path / "tables"))
    assert sorted((r.doc_id, r.content) for r in log.read("chunks").collect()) == [("d0.txt", "text 0"), ("d1.txt", "text 1")]
    assert log.committed() == [0, 1]


def test_state_machine():
    s = DocumentState()
    steps = [("processing", None, None), (None, 62, "Built document digest"), (None, 40, None), ("pending", None, None), (None, 85, None), ("indexed", None, None), (None, 10, None), ("failed", None, None), ("processing", None, None), (None, 300, None), ("lost", None, None), ("failed", None, "Failed: no text")]
    got = [(s.update(*x), *s.row()) for x in steps]
    assert got == [
        (True, "processing", 2, "Queued", 1), (True, "processing", 62, "Built document digest", 1), (False, "processing", 62, "Built document digest", 1), (False, "processing", 62, "Built document digest", 1), (True, "processing", 85, "Built document digest", 1),
        (True, "indexed", 100, "Completed", 1), (False, "indexed", 100, "Completed", 1), (False, "indexed", 100, "Completed", 1), (True, "processing", 2, "Queued", 2), (True, "processing", 100, "Queued", 2), (False, "processing", 100, "Queued", 2), (True, "failed", 100, "Failed: no text", 2),
    ]


def test_state_stream_with_restarts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(d, i, rng.choice([None, "pending", "processing", "processing", "indexed", "failed", "?"]), rng.choice([None, rng.randrange(-5, 120)]), rng.choice([None, f"m{i}"])) for d in range(8) for i in range(15)]
    schema = "doc long, seq int, status string, progress int, message string"
    want, states = [], {}
    for d, i, status, progress, message in rows:
        s = states.setdefault(d, DocumentState())
        if s.update(status, progress, message):
            want.append((d, i, *s.row()))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for run in range(2):
            part = [r for r in rows if (r[1] < 7) == (run == 0)]
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "source"))
            stream = state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "source")), "doc")
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert query.awaitTermination(100)
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "sink")).collect())) == sorted(want)
