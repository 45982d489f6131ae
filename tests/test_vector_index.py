"""Vector cells against the exact neighbours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.vector_index import build_index, load_index, probes_for, recall, search_index

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def questions(vectors):
    return vectors.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in df.collect())


def test_recall_and_all_cells(spark, vectors, questions, tmp_path):
    index = build_index(vectors)
    assert index.rows.count() == vectors.count() and index.rows.select("vec_id").distinct().count() == vectors.count()
    exact = retrieval.nearest(vectors, questions, 10)
    assert recall(search_index(index, questions, 10), exact) >= 0.9
    assert rows(search_index(index, questions, 10, probes=10**6)) == rows(exact)
    few = probes_for(index, questions, exact, 0.9)
    assert recall(search_index(index, questions, 10, few), exact) >= 0.9 > recall(search_index(index, questions, 10, few - 1), exact)
    # The saved index finds the same, and a search reads the folders of its cells.
    index.save(str(tmp_path / "index"))
    saved = load_index(spark, str(tmp_path / "index"))
    assert rows(search_index(saved, questions, 10)) == rows(search_index(index, questions, 10))
    plan = search_index(saved, questions, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "PartitionFilters" in plan and "dynamicpruning" in plan


def test_clusters_need_few_probes(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 10
    data = [(i, (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(800)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = frame.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = build_index(frame, cells=20)
    exact = retrieval.nearest(frame, asked, 10)
    assert probes_for(index, asked, exact, 0.95) <= 5
    assert recall(search_index(index, asked, 10, 5), exact) >= 0.95
    assert max(r.probes for r in index.centres.collect()) <= 5 and recall(search_index(index, asked, 10), exact) >= 0.9


def test_large_cells_bad_rows_and_empty_tables(spark):
    data = [(i, [1.0, 2.0]) for i in range(200)] + [(500, [9.0, 9.0]), (501, None), (502, [math.nan, 1.0]), (503, [1.0, None]), (504, [math.inf, 1.0]), (505, [1.0]), (506, [])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = build_index(frame, cells=2, part_rows=50)
    assert index.rows.count() == 201
    assert max(r.parts for r in index.centres.collect()) >= 4 and index.rows.filter("vec_id < 200").select("part").distinct().count() >= 4
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [8.0, 9.0])], "query_id long, query array<double>")
    got = rows(search_index(index, asked, 3))
    assert [g[:3] for g in got] == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (3, 1, 500), (3, 2, 0), (3, 3, 1)]
    assert search_index(build_index(frame.limit(0)), asked, 3).count() == 0


def joined(df):
    """Rows that the joins of a plan have made."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        else:
            if p.nodeName().endswith("Join"):
                rows += p.metrics().apply("numOutputRows").value()
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_no_row_for_each_pair(spark, vectors, questions):
    """500 vectors and 20 questions that look into all cells: 10,000 pairs."""
    assert joined(search_index(build_index(vectors), questions, 10, probes=10**6)) < 2000


def test_blocks_slots_and_ties(spark, monkeypatch):
    """Many blocks and slots, keys of text, equal distances and a question that stands twice: as the exact search where all cells are probed."""
    from docloom.operators import vector_index

    for name, value in (("SLOT_ROWS", 60), ("QUESTIONS", 9), ("ROWS", 16), ("PAIRS", 64)):
        monkeypatch.setattr(vector_index, name, value)
    rng = np.random.default_rng(3)
    data = [(f"k{i:03d}", [float(c) for c in rng.integers(0, 3, 3)]) for i in range(400)]
    frame = spark.createDataFrame(data, "name string, v array<double>").repartition(3)
    asked = frame.filter("substr(name, 4) = '0'").selectExpr("name as query_id", "v as query")
    asked = asked.unionAll(asked.limit(1))
    found = search_index(build_index(frame, "name", "v", cells=7, part_rows=50), asked, 5, probes=10**6)
    exact = retrieval.nearest(frame, asked, 5, "name", "v")
    show = lambda df: sorted((r.query_id, r["rank"], r.name, r.distance) for r in df.collect())
    assert show(found) == show(exact) and len(show(found)) == 200
