"""Counts of a key's earlier events, event by event, as a stream with state by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400


class TrailingCounts(StatefulProcessor):
    """Holds events back until the watermark has passed them, then counts them in the order of time.

    State of a key: waiting (events that are not final yet), seen (final events by second, as long as a later event can still count them) and due (the one
    timer that is set: when the next event becomes final, or else when the oldest second no longer counts). A key whose events have all gone by has no state.
    """

    def __init__(self, days: tuple[int, ...], tie_type: T.DataType):
        self.days, self.tie_type = days, tie_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType().add("micros", T.LongType()).add("tie", self.tie_type))
        self.seen = handle.getListState("seen", T.StructType().add("second", T.LongType()).add("n", T.LongType()))
        self.due = handle.getValueState("due", T.StructType().add("at", T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendList(list(zip(frame["micros"].tolist(), frame["tie"].tolist(), strict=True)))
            first = min(x for x in (first, int(frame["micros"].min())) if x is not None)
        if first is not None:
            self._wake(first // 1000, sooner=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._final(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _wake(self, at: int, sooner: bool = False) -> None:
        """Sets the key's timer, in milliseconds; sooner: only if it would ring later, or not at all. Otherwise the one before must have rung."""
        if sooner and (before := self.due.get()) is not None:
            if before[0] <= at:
                return
            self.handle.deleteTimer(before[0])
        self.due.update((at,))
        self.handle.registerTimer(at)

    def _final(self, key, until: int) -> Iterator[pd.DataFrame]:
        """Counts the waiting events up to the watermark and forgets what no later event can count."""
        events = [(r[0], r[1]) for r in self.waiting.get()]
        done, left = sorted(e for e in events if e[0] <= until), [e for e in events if e[0] > until]
        before_round = {r[0]: r[1] for r in self.seen.get()}
        counted = dict(before_round)
        if done:
            seconds = np.array([m // 1_000_000 for m, _ in done])
            old = np.array(sorted(counted), np.int64)
            # Earlier events: those seen before, by second, and those of this round that come first in order.
            before = np.concatenate([[0], np.cumsum([counted[s] for s in old.tolist()])]).astype(np.int64)
            out = {"who": [key[0]] * len(done), "micros": [m for m, _ in done], "tie": [t for _, t in done]}
            for n in self.days:
                starts = seconds - n * DAY
                out[f"last_{n}_days"] = before[-1] - before[np.searchsorted(old, starts)] + np.arange(len(done)) - np.searchsorted(seconds, starts)
            yield pd.DataFrame(out)
            for second, n in zip(*np.unique(seconds, return_counts=True), strict=True):
                counted[int(second)] = counted.get(int(second), 0) + int(n)
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        span = max(self.days) * DAY
        counted = {s: n for s, n in counted.items() if (s + span) * 1_000_000 >= until}
        # Every call to the state is a message to the JVM: the seconds are written at once.
        if counted and counted != before_round:
            self.seen.put(list(counted.items()))
        elif before_round and not counted:
            self.seen.clear()
        if left:
            self._wake(min(left)[0] // 1000)
        elif counted:
            self._wake((min(counted) + span + 1) * 1000)
        else:
            self.due.clear()


def trailing_counts(events: DataFrame, ts: str, keys: list[str], tie: str, days: tuple[int, ...], late: str = "0 seconds") -> DataFrame:
    """keys, ts, tie and last_n_days for each of days: the key's events that come before in the order (ts, tie), from n days before the event's second on.

    An event is given out once, when the watermark (latest time less late) has passed it; one that comes after that is dropped, as ever in Spark. Events without
    a time or a tie are left out; null keys are a key. Keys are strings or whole numbers. Needs the RocksDB state store. A key is counted in one task, which
    holds its waiting events and one number for each second with events in the longest span.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    source = events.where(F.col(ts).isNotNull() & F.col(tie).isNotNull())
    # One key column that is never null, and names that pandas leaves alone. The watermark knows milliseconds: rounded up, it has passed all that was read.
    rows = source.select(F.to_json(F.struct(*keys)).alias("who"), micros.alias("micros"), F.col(tie).alias("tie"), F.timestamp_millis(F.expr("(micros + 999) div 1000")).alias("at"))
    tie_type = rows.schema["tie"].dataType
    schema = T.StructType().add("who", "string").add("micros", "long").add("tie", tie_type)
    for n in days:
        schema = schema.add(f"last_{n}_days", "long")
    counted = rows.withWatermark("at", late).groupBy("who").transformWithStateInPandas(TrailingCounts(days, tie_type), schema, "Append", "EventTime")
    found = F.from_json("who", T.StructType([source.schema[k] for k in keys]))
    return counted.select(*[found[k].alias(k) for k in keys], F.timestamp_micros("micros").alias(ts), F.col("tie").alias(tie), *[f"last_{n}_days" for n in days])
