"""The guard of a stream of tokens against the guard of a table, over restarts."""

import random

import pytest

from docloom.streaming.guard import SAFE_MESSAGE, GuardState, guard_stream, guard_tokens

PARTS = ["plain words ", "SELECT", "ion of ", " a FROM t", "Traceback (most ", "recent call last):", "sk-", "abc", "defghijk", "-" * 12, "Bearer", "   ", "token.value123", "a@b.co ", "me@", "you.org", "```", " \n", "sql", "postgres", "://", "host ", "UPDATE", "D. ", "x" * 350, " " * 310, "deleted ", ".", "\n"]
SCHEMA = "answer long, seq int, token string, last boolean"


def answers(n, seed=4):
    rng = random.Random(seed)
    out = []
    for a in range(n):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 12))))
        tokens = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
        out += [(a, i, t, i == len(tokens) - 1) for i, t in enumerate(tokens)]
    return out


@pytest.fixture(scope="module")
def rows():
    return answers(250)


@pytest.fixture(scope="module")
def want(spark, rows):
    table = guard_tokens(spark.createDataFrame(rows, SCHEMA), "answer", "seq", "token")
    return {(r.answer, r.seq): (r.released, r.blocked) for r in table.collect()}


def test_token_by_token(rows, want):
    got, guards = {}, {}
    for a, i, t, last in rows:
        g = guards.setdefault(a, GuardState())
        g = guards[a] = GuardState(*g.row())
        got[a, i] = (g.push(t, last), g.blocked)
    assert got == want
    assert sum(v[0] == SAFE_MESSAGE for v in want.values()) > 10


def test_looks_at_little_more_than_the_new_text():
    guard = GuardState()
    for _ in range(3000):
        guard.push("quite harmless words, one after the other. ")
    assert len(guard.tail) < 400 and guard.held == ""


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_with_restarts(spark, rocks, rows, want, tmp_path):
    some = [r for r in rows if r[0] < 12]
    source, sink, at = (str(tmp_path / x) for x in ("source", "sink", "checkpoint"))
    for batch in range(3):
        # Each answer's tokens are spread over three runs of the query, each of which goes on from the checkpoint.
        part = [r for r in some if min(r[1] // 3, 2) == batch]
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = guard_stream(spark.readStream.schema(SCHEMA).parquet(source), "answer", "seq", "token", "last")
        run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert run.awaitTermination(100)
        assert run.exception() is None
    got = {(r.answer, r.seq): (r.released, r.blocked) for r in spark.read.parquet(sink).collect()}
    assert got == {k: v for k, v in want.items() if k[0] < 12}
