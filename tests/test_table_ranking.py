"""Table chunks are ranked by all their words."""

from docloom.operators import search


def test_words_behind_the_beginning_count(spark):
    far = "filler " * 400
    rows = [(1, 1, "revenue by segment", far + "Revenue BY", 0.0, 0.0, False), (1, 2, "revenue by segment", far + "by", 0.0, 0.0, False), (1, 3, "revenue by segment", far * 20 + "\nsegment by\trevenue", 0.0, 0.0, False)]
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, query string, content string, similarity double, score double, prior boolean")
    got = [(r.place, r.chunk_id, r.relevance) for r in search.rank_tables(frame).orderBy("place").collect()]
    assert got == [(1, 3, 0.25), (2, 1, 0.166667), (3, 2, 0.083333)]
