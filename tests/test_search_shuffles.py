"""What a search sends through exchanges."""

from docloom.operators import search


def shuffled(spark, df):
    """The rows that a plan's exchanges have written."""
    rows = 0
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if p.nodeName() == "Exchange":
            rows += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_search_shuffles_hits_not_pairs(spark):
    """600 chunks and 40 questions with words in common: 24,000 pairs of them, of which each block gives its best."""
    chunks = spark.createDataFrame([(i, f"the word number w{i % 50}", [float(i), 1.0]) for i in range(600)], "chunk_id long, content string, embedding array<float>").repartition(2)
    questions = spark.createDataFrame([(q, f"the word w{q}", [float(q), 0.0]) for q in range(40)], "query_id long, text string, vector array<float>")
    found = search.hybrid_search(chunks, questions, 3)
    # The rows of the tables themselves go through the test's own exchange.
    assert shuffled(spark, found) < 6000
