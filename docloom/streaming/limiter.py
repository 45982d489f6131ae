"""Rate limits: an event passes if fewer than limit passed in the window before it; refused events count for nothing.

Whether one passes depends on which before it passed, so the fold is sequential by key: state of at most limit times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def passed(times: list[float], limit: int, window: float, earlier: deque | None = None) -> tuple[list[bool], deque]:
    """Whether each of the ascending times passes, and the times that still count afterwards."""
    kept = deque() if earlier is None else earlier
    out = []
    for t in times:
        while kept and kept[0] <= t - window:
            kept.popleft()
        ok = limit <= 0 or len(kept) < limit
        if ok and limit > 0:
            kept.append(t)
        out.append(ok)
    return out, kept


def limit_events(events: DataFrame, key: str, ts: str, ident: str, limit: int, window_seconds: float) -> DataFrame:
    """(key, ident, ts, passed) of every event of a table.

    Sorted by key and time within partitions and folded over batches: a key's rows stream by, they are never held together.
    """
    kinds = dict(events.dtypes)
    rows = events.select(key, ident, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), deque()
        for batch in batches:
            flags = []
            for k, t in zip(batch[key], batch["_t"], strict=True):
                if k != now:
                    now, kept = k, deque()
                ok, kept = passed([t], limit, window_seconds, kept)
                flags += ok
            yield batch.drop(columns="_t").assign(passed=flags)

    ordered = rows.repartition(key).sortWithinPartitions(key, "_t", ident)
    return ordered.mapInPandas(fold, f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, `{ts}` {kinds[ts]}, passed boolean")


def limit_stream(events: DataFrame, key: str, ts: str, ident: str, limit: int, window_seconds: float) -> DataFrame:
    """The same for a stream of events, with the state kept by Spark; events of a batch are taken in time order."""
    kinds = dict(events.dtypes)
    rows = events.select(F.col(key), F.col(ident), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))

    def step(k, batches, state):
        kept = deque(state.get[0]) if state.exists else deque()
        every = pd.concat(list(batches)).sort_values(["t", ident])
        flags, kept = passed(every["t"].tolist(), limit, window_seconds, kept)
        state.update((list(kept),))
        yield pd.DataFrame({key: every[key], ident: every[ident], "passed": flags})

    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, passed boolean", "kept array<double>", "append", "NoTimeout")
