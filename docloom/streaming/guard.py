"""Guarded answers: tokens are released up to the first place where something risky may begin, the rest when it proves harmless."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions.policy import EMAIL, OUTPUT_RULES, RISK_ANCHOR, risk_anchor_offset, screen_output

SAFE_MESSAGE = "This answer was withheld."


def static_tokens(text: Column) -> Column:
    """Words of a fixed text, each but the first with its blank before it."""
    return F.transform(F.split(text, " "), lambda w, i: F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w))


def guard_tokens(tokens: DataFrame, answer: str, seq: str, token: str) -> DataFrame:
    """(answer, seq, released, blocked): what each token lets out.

    The text so far is screened anew with each token: a hit blocks the answer from there on; otherwise everything before
    the first risky place goes out, and at the last token all of it.
    """
    w = Window.partitionBy(answer).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    grown = tokens.withColumn("_text", F.array_join(F.collect_list(token).over(w), ""))
    last = F.max(seq).over(Window.partitionBy(answer)) == F.col(seq)
    seen = grown.withColumn("_last", last).withColumn("_bad", screen_output(F.col("_text")).isNotNull())
    blocked = F.max(F.col("_bad").cast("int")).over(w) == 1
    free = F.when(F.col("_last"), F.length("_text")).otherwise(F.coalesce(risk_anchor_offset(F.col("_text")), F.length("_text")))
    seen = seen.withColumn("blocked", blocked).withColumn("_free", F.when(~F.col("blocked"), free))
    done = F.coalesce(F.max("_free").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("_done", done)
    first_block = F.col("blocked") & ~F.coalesce(F.lag("blocked").over(Window.partitionBy(answer).orderBy(seq)), F.lit(False))
    out = F.when(first_block, SAFE_MESSAGE).when(F.col("blocked"), "").otherwise(F.expr("substring(_text, _done + 1, greatest(_free - _done, 0))"))
    return seen.select(answer, seq, out.alias("released"), "blocked")


_ANCHOR = re.compile(RISK_ANCHOR, re.ASCII)
_RULES = [re.compile(p, re.ASCII) for _, p in OUTPUT_RULES]
_EMAIL = re.compile(EMAIL, re.ASCII)
#: What is still open at the end of a text: a run of signs of an address or key, and what may stand before it at any distance.
_OPEN = re.compile(r"(?:(?:```|\bBearer)\s*)?[A-Za-z0-9._%+@-]*\Z", re.ASCII)
_CLOSING = re.compile(r"[^A-Za-z0-9._%+@-]")
#: No anchor is longer than this, nor does a rule's shortest hit reach further back, but for what is open.
REACH = 300
#: Addresses that make an answer possible_pii.
ADDRESSES = 3


class GuardState:
    """What guard_tokens does, token by token; each looks at the new text and little more than the last REACH signs.

    Every rule's shortest hit begins at an anchor and ends in the new text. Text is released up to the first anchor; one that
    ends where the text ends may still turn out to be the beginning of a longer word, so it is looked at again.
    """

    FIELDS = "length int, released int, anchor int, addresses int, blocked boolean, tail string, held string"

    def __init__(self, length: int = 0, released: int = 0, anchor: int = -1, addresses: int = 0, blocked: bool = False, tail: str = "", held: str = ""):
        self.length, self.released, self.anchor, self.addresses, self.blocked, self.tail, self.held = length, released, anchor, addresses, blocked, tail, held

    def row(self) -> tuple:
        return self.length, self.released, self.anchor, self.addresses, self.blocked, self.tail, self.held

    def push(self, token: str, last: bool = False) -> str:
        """What a token lets out: SAFE_MESSAGE where the answer is blocked, and nothing from there on."""
        if self.blocked:
            return ""
        seen, base = self.tail + token, self.length - len(self.tail)
        self.length += len(token)
        self.held += token
        if any(r.search(seen) for r in _RULES) or self.addresses + sum(1 for _ in _EMAIL.finditer(seen)) >= ADDRESSES:
            self.blocked, self.tail, self.held = True, "", ""
            return SAFE_MESSAGE
        first = _ANCHOR.search(seen) if self.anchor < 0 else None
        free = self.anchor if self.anchor >= 0 else base + first.start() if first else self.length
        if first and first.end() < len(seen):
            self.anchor = free
        # What is cut off ends before everything that may still grow, at a sign that belongs to no address, key or word.
        keep = min(len(seen) - REACH, _OPEN.search(seen).start(), first.start() if first else len(seen))
        cut = max((m.end() for m in _CLOSING.finditer(seen, 0, max(keep, 0))), default=0)
        self.addresses += sum(1 for _ in _EMAIL.finditer(seen[:cut]))
        self.tail = seen[cut:]
        return self._release(self.length if last else free)

    def _release(self, free: int) -> str:
        out = self.held[: max(0, free - self.released)]
        self.held, self.released = self.held[len(out) :], self.released + len(out)
        return out


class GuardProcessor(StatefulProcessor):
    """The guard of one answer's tokens in a stream. Where no token comes for idle_ms, the answer counts as ended."""

    def __init__(self, schema: str, idle_ms: int | None):
        self.columns, self.idle_ms = [c.split()[0].strip("`") for c in schema.split(", ")], idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("guard", GuardState.FIELDS)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.columns).astype({self.columns[1]: "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        guard = GuardState(*self.value.get()) if self.value.exists() else GuardState()
        out, ended = [], False
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            ended = ended or bool(r.last)
            out.append((r.seq, guard.push(r.token or "", bool(r.last)), guard.blocked))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if ended:
            self.value.clear()
        else:
            self.value.update(guard.row())
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.value.exists():
            guard = GuardState(*self.value.get())
            self.value.clear()
            yield self._frame(key, [(None, "" if guard.blocked else guard.held, guard.blocked)])

    def close(self) -> None:
        pass


def guard_stream(tokens: DataFrame, answer: str, seq: str, token: str, last: str, idle_ms: int | None = None) -> DataFrame:
    """(answer, seq, released, blocked) of a stream of tokens, as guard_tokens gives them for a table; last marks an answer's last token.

    Tokens of an answer come in the order of seq from batch to batch. idle_ms: after so long without a token the held rest goes
    out with a null seq. The session needs the RocksDB state store.
    """
    kinds = dict(tokens.dtypes)
    schema = f"`{answer}` {kinds[answer]}, `{seq}` long, released string, blocked boolean"
    rows = tokens.select(answer, F.col(seq).cast("long").alias("seq"), F.col(token).alias("token"), F.col(last).alias("last"))
    return rows.groupBy(answer).transformWithStateInPandas(GuardProcessor(schema, idle_ms), schema, "append", "none" if idle_ms is None else "processingTime")
