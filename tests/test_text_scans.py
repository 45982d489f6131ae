"""Scans of long texts: objects by their own braces, phrases found in a text that is made once."""

import random

from pyspark.sql import functions as F

from docloom.functions import policy as P


def end_of(text):
    """The object at the start of a text, sign by sign."""
    depth, quoted, escaped = 0, False, False
    if not text.startswith("{"):
        return None
    for n, c in enumerate(text, 1):
        free = not quoted
        depth += (c == "{") - (c == "}") if free else 0
        after = quoted and c == "\\" and not escaped
        if c == '"' and not escaped:
            quoted = free
        escaped = after
        if free and depth == 0 and c == "}":
            return text[:n]
    return None


def test_objects_sign_by_sign(spark):
    rng = random.Random(4)
    texts = ["{" + "".join(rng.choice(['"', "{", "}", "\\", "a", "é", "𝒳", "\n"]) for _ in range(rng.randrange(14))) for _ in range(1500)] + ["", "x{}", '{"a": "}\\"}"} rest}', "{}\\"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.json_object(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == [end_of(r.t) for r in got]


def test_work_is_by_marks_and_texts_not_by_signs(spark):
    """The plan neither splits a text into its signs nor makes it anew for each phrase."""
    texts = spark.createDataFrame([("a",)], "t string")
    plan = lambda c: texts.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan(P.json_object(F.col("t")))
    assert plan(P.numeric_comparison(F.col("t"))).count("lower(") == 1


def test_phrases_of_null_and_odd_texts(spark):
    rows = [(None,), ("",), ("Year-over-year",), ("a vs b",), ("2019 and 2020",), ("2019 and 12020",), ("nets",), ("NET ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.numeric_comparison(F.col("t"))).collect()]
    assert got == [None, False, True, True, True, False, False, True]
