"""Toxicity by weak supervision.

Voters are features of a text: words of a fixed lexicon, and words and word beginnings (patterns, in whatever language)
proposed from a development half of the labelled rows. A generative label model takes the true label as hidden. It starts
from the voters' rates on the development half, first judges all rows by the voters alone, and estimates by EM how often
each voter speaks in either class; the given label is but one more noisy voter, whose accuracy is estimated too. Voters that go together beyond what the class explains are modelled
together: a group of correlated voters has one joint distribution of how many of them speak (none, one, a few, many) in
either class, so a stem and its beginnings count once. The model's posterior labels train a linear classifier over the
same kind of features, which scores every text in one scan without a shuffle.

Features are hashed to 2^20 numbers: words of digits, letters and code points from U+0080 with A-Z lower-cased, and their
first 4 to 8 bytes. Only the text is read for a score.

The models are fitted on SAMPLE labelled rows at most (a documented bound): those whose crc32(id as text) mod 5 is not 0,
in the order of a hash of their id. The features of these rows, not of the corpus, come to the driver.

Cases: null and empty texts have no features and get the intercept's score; a very long text is scored whole, a block by
itself; rows that repeat an id are scored each, and teach with
the smallest of their texts; label
rows with a null label, or whose id no document has, teach nothing; without labels of both classes every score is the
share of toxic labels (0 without any); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._storage import release, small_batches, tidy
from docloom.llm._text import ALNUM, LOWER, U64, blocks, find_words, span_hashes

SAMPLE, VOTERS, FEATURES = 8_000, 300, 4_000
#: Labelled rows that propose voters: half of the sample, and this many where there are.
DEVELOPMENT = 1_000
#: Correlation beyond the class from which voters are modelled together; the numbers of a group's voters that begin a new state.
LINKED, STATES = 0.3, (1, 2, 4)
SPACE_BITS, PREFIXES = 20, (4, 5, 6, 7, 8)
#: Insults that vote for toxic wherever they stand.
LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "imbecile", "fool", "vermin", "filth", "jerk", "creep", "coward", "liar")


def _features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row), distinct and sorted by row; wanted: a mask of the features to keep."""
    low = LOWER[data]
    start, end, row = find_words(low, offsets, ALNUM)
    space = U64(64 - SPACE_BITS)
    found, rows = [], []
    for width in (0, *PREFIXES):
        long = np.flatnonzero(end - start > width) if width else np.arange(len(start))
        h = span_hashes(low, start[long], start[long] + width if width else end[long])
        f = (h >> space).astype(np.int64) if not width else ((h * U64(2 * width + 1)) >> space).astype(np.int64)
        r = row[long]
        if wanted is not None:
            keep = wanted[f]
            f, r = f[keep], r[keep]
        found.append(f)
        rows.append(r)
    key = np.unique(np.concatenate(rows) << SPACE_BITS | np.concatenate(found))
    return key & ((1 << SPACE_BITS) - 1), key >> SPACE_BITS


def _sample_features(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The features and labels of the training rows."""
    label = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    label = label.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = label.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    # At most SAMPLE small rows: safe to send to every task.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text")).select("_y", "_text", "_id")
    schema = "id long, y int, features binary"
    arrow = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                f, row = _features(data, offsets)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo).cast(pa.int64()), batch.column(0).slice(lo, hi - lo), pa.array([f[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], schema=arrow)

    # In an order of no meaning, so that either half is like the other.
    got = sorted((zlib.crc32(str(r["id"]).encode()), r["id"], r["y"], bytes(r["features"])) for r in rows.mapInArrow(tidy(run), schema).toLocalIterator())
    return [np.frombuffer(x[3], "<u4") for x in got], np.array([x[2] for x in got], np.float64)


def _association(features: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each feature: the log odds ratio's z score for toxic, and its counts in either class."""
    pos, neg = np.zeros(1 << SPACE_BITS, np.float32), np.zeros(1 << SPACE_BITS, np.float32)
    for f, toxic in zip(features, y > 0.5, strict=True):
        (pos if toxic else neg)[f] += 1
    n1 = float((y > 0.5).sum())
    n0 = len(y) - n1
    a, b, c, d = pos + 0.5, n1 - pos + 0.5, neg + 0.5, n0 - neg + 0.5
    return (np.log(a) - np.log(b) - np.log(c) + np.log(d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d), pos, neg


def lexicon_features() -> np.ndarray:
    text = " ".join(LEXICON).encode()
    data = np.frombuffer(text, np.uint8)
    start, end, _ = find_words(data, np.array([0, len(data)]), ALNUM)
    return (span_hashes(data, start, end) >> U64(64 - SPACE_BITS)).astype(np.int64)


def correlated(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The group of each voter: groups are connected by correlations over LINKED that the class q doesn't explain."""
    on1, on0 = votes.T @ q / max(q.sum(), 1e-9), votes.T @ (1 - q) / max((1 - q).sum(), 1e-9)
    rest = votes - np.outer(q, on1) - np.outer(1 - q, on0)
    spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
    near = np.abs(rest.T @ rest / len(q)) > LINKED * np.outer(spread, spread)
    group = np.arange(votes.shape[1])
    while True:
        least = np.where(near, group[None, :], len(group)).min(axis=1)
        new = np.minimum(group, least)
        if (new == group).all():
            return np.unique(group, return_inverse=True)[1]
        group = new


def label_model(votes: np.ndarray, y: np.ndarray, development: int | None = None, rounds: int = 25) -> dict[str, np.ndarray]:
    """EM over voters (rows x voters, 0 or 1) and the given labels.

    It starts from the rates that voters have on the first development rows, by their labels (default: half of the rows).
    posterior: of each row. group: of each voter. on_toxic, on_other: groups x STATES, how often so many of a group speak.
    label: how often the given label says toxic in either class.
    """
    n, m = votes.shape
    votes = votes.astype(np.float32)
    d = n // 2 if development is None else development
    known = np.arange(n) < d
    q = np.where(known, np.clip(y, 0.05, 0.95), 0.0)
    for turn in range(rounds):
        if turn in (0, rounds // 3, 2 * rounds // 3):
            # Which voters go together is seen best once the class is known better.
            group = correlated(votes[:d], q[:d].astype(np.float32)) if not turn else correlated(votes, q.astype(np.float32))
            count = np.stack([votes[:, group == g].sum(axis=1) for g in range(group.max(initial=-1) + 1)], axis=1).astype(np.int64) if m else np.zeros((n, 0), np.int64)
            kinds, groups = len(STATES) + 1, count.shape[1]
            place = np.digitize(count, STATES) + np.arange(groups) * kinds
        p = (q.sum() + 1) / (known.sum() + 2)
        seen = lambda weight: np.bincount(place.ravel(), np.repeat(weight, groups), groups * kinds).reshape(groups, kinds) + 0.5  # noqa: B023, E731
        on1, on0 = seen(q), seen(known - q)
        on1, on0 = on1 / on1.sum(axis=1, keepdims=True), on0 / on0.sum(axis=1, keepdims=True)
        hit = np.clip(((q * y).sum() + 9) / (q.sum() + 10), 0.5, 0.99)
        false = np.clip((((known - q) * y).sum() + 1) / ((known - q).sum() + 20), 0.002, 0.5)
        say = np.log(on1 / on0).ravel()
        logit = np.log(p / (1 - p)) + say[place].sum(axis=1)
        if turn:
            logit += np.where(y > 0.5, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        q, known = 1 / (1 + np.exp(-np.clip(logit, -30, 30))), np.ones(n)
    return {"posterior": q, "group": group, "on_toxic": on1, "on_other": on0, "label": np.array([hit, false])}


def _classifier(features: list[np.ndarray], q: np.ndarray, chosen: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on the chosen features' presence by full-batch Adam with a ridge. (weights, intercept)"""
    column = np.full(1 << SPACE_BITS, -1)
    column[chosen] = np.arange(len(chosen))
    cols = [column[f] for f in features]
    cols = [c[c >= 0] for c in cols]
    flat = np.concatenate([*cols, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    w, b = np.zeros(len(chosen)), float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n = len(q)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[flat], n) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - q
        gw, gb = np.bincount(flat, g[owner], len(chosen)) / n + 2e-5 * w, g.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.1 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[np.ndarray, float]:
    """(a weight for each hashed feature, intercept)."""
    features, y = _sample_features(docs, labels, text_col, id_col)
    table = np.zeros(1 << SPACE_BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return table, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    development = min(len(y), max(len(y) // 2, DEVELOPMENT))
    z, pos, neg = _association(features[:development], y[:development])
    known = lexicon_features()
    ranked = np.argsort(-z, kind="stable")
    # Few rows reach no large score however good a voter is.
    likely = ranked[(pos[ranked] >= 3) & (z[ranked] > min(3.5, 0.3 * development**0.5))]
    voters = np.unique(np.concatenate([known, likely[:VOTERS]]))
    votes = np.stack([np.isin(voters, f) for f in features])
    q = label_model(votes, y, development)["posterior"]
    z, pos, neg = _association(features, q)
    ranked = np.argsort(-np.abs(z), kind="stable")
    chosen = ranked[(pos + neg)[ranked] >= 4]
    chosen = np.unique(np.concatenate([voters, chosen[np.abs(z[chosen]) > 2.0][:FEATURES]]))
    w, b = _classifier(features, q, chosen)
    table[chosen] = w
    del features, votes, z, pos, neg
    release()
    return table, b


def score_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs. keep: instead of the id, these columns in a struct named row."""
    small_batches(docs.sparkSession)
    table, b = fit(docs, labels, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.col(id_col)
    first = "row" if keep else id_col
    source = docs.select(carried, F.col(text_col).alias("_text"))
    kind = source.schema[first].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        wanted = weights != 0
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                f, row = _features(data, offsets, wanted)
                z = np.bincount(row, weights[f], hi - lo) + b
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[first, "score"])

    scored = source.mapInArrow(tidy(run), f"`{first}` {kind}, score double" if not keep else source.select("row").schema.add("score", "double"))
    doc_id = F.col(f"row.`{id_col}`") if keep else F.col(id_col)
    held = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select(first, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs, whole rows, without those predicted toxic."""
    return score_documents(docs, labels, text_col, id_col, docs.columns).filter("predicted = 0").select("row.*")
