"""States of documents on their way into the index, as a machine that a stream of updates drives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Each state with the progress at which it begins and what it says.
STEPS = {"pending": (0, "Uploaded"), "processing": (2, "Queued"), "indexed": (100, "Completed"), "failed": (100, "Failed")}
ENDED = ("indexed", "failed")


class DocumentState:
    """pending, processing, then indexed or failed. Within a run progress never falls; only processing leads out of an end, into a new run."""

    FIELDS = "status string, progress int, message string, run int"

    def __init__(self, status: str = "pending", progress: int = 0, message: str = STEPS["pending"][1], run: int = 0):
        self.status, self.progress, self.message, self.run = status, progress, message, run

    def row(self) -> tuple:
        return self.status, self.progress, self.message, self.run

    def update(self, status: str | None, progress: int | None, message: str | None) -> bool:
        """Whether an update changes anything: one that leads nowhere is left out, what it doesn't say stays."""
        before = self.row()
        if status is not None and status not in STEPS:
            return False
        if self.status in ENDED:
            if status != "processing":
                return False
            self.progress, self.run = 0, self.run + 1
        elif status == "pending" and self.status == "processing":
            return False
        elif status == "processing" and self.status == "pending":
            self.run += 1
        if status is not None and status != self.status:
            self.status, least, self.message = status, *STEPS[status]
            self.progress = max(self.progress, least)
        if progress is not None and self.status not in ENDED:
            self.progress = max(self.progress, min(100, max(0, progress)))
        if message is not None:
            self.message = message
        return self.row() != before


class StateProcessor(StatefulProcessor):
    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", DocumentState.FIELDS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = DocumentState(*self.value.get()) if self.value.exists() else DocumentState()
        out = []
        given = lambda x: None if pd.isna(x) else x
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            progress = given(r.progress)
            if state.update(given(r.status), None if progress is None else int(progress), given(r.message)):
                out.append((key[0], int(r.seq), *state.row()))
        self.value.update(state.row())
        yield pd.DataFrame(out, columns=[self.key, "seq", "status", "progress", "message", "run"])

    def close(self) -> None:
        pass


def state_stream(updates: DataFrame, key: str) -> DataFrame:
    """(key, seq, status, progress, message, run) after each update of a stream that changes a document's state.

    updates: key, seq (their order), status, progress and message, of which an update may leave out any. Updates of a document
    come in the order of seq from batch to batch. The session needs the RocksDB state store.
    """
    kind = dict(updates.dtypes)[key]
    schema = f"`{key}` {kind}, seq long, status string, progress int, message string, run int"
    rows = updates.selectExpr(f"`{key}`", "cast(seq as long) as seq", "status", "cast(progress as int) as progress", "message")
    return rows.groupBy(key).transformWithStateInPandas(StateProcessor(key), schema, "append", "none")
