"""The stream of trailing counts against the same counts worked out over all events at once."""

import datetime as dt

from tipline.streaming.merge import rocksdb
from tipline.streaming.trailing import trailing_counts

SCHEMA = "who string, ts timestamp, n long"
T0 = dt.datetime(2024, 3, 1, 12)


def at(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


def brute(rows, days) -> set:
    out = set()
    second = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp())
    for who, ts, n in rows:
        earlier = [r for r in rows if r[0] == who and (r[1], r[2]) < (ts, n)]
        out.add((who, ts, n, *(sum(second(r[1]) >= second(ts) - d * 86_400 for r in earlier) for d in days)))
    return out


class Feed:
    """Files that come one after the other, and a query that is started anew for each from the same checkpoint."""

    def __init__(self, spark, folder, late="0 seconds"):
        self.spark, self.folder, self.late, self.n = spark, folder, late, 0

    def __call__(self, rows) -> set:
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in")
        counted = trailing_counts(stream, "ts", ["who"], "n", (1, 3), self.late)
        with rocksdb(self.spark):
            counted.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return {tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").select("who", "ts", "n", "last_1_days", "last_3_days").collect()}

    def state(self, name: str) -> int:
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.folder}/checkpoint").count()


def test_restarts_equal_one_run_and_state_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    first = [("a", at(h / 3), h) for h in range(40)] + [(None, at(h), 100 + h) for h in range(12)] + [("a", at(5), 200), ("a", at(5), 201)]
    second = [("a", at(14 + 5 * h), 300 + h) for h in range(20)] + [("b", at(20), 400), (None, at(110), 401)]
    assert feed(first) == brute(first, (1, 3))
    assert feed(second) == brute(first + second, (1, 3))
    assert feed.state("waiting") == 0 and feed.state("seen") > 0
    # A month later only the last event's second is kept: all others can be counted no more.
    third = [("c", at(24 * 30), 500)]
    assert feed(third) == brute(first + second + third, (1, 3))
    assert feed.state("seen") == 1 and feed.state("due") == 1


def test_events_wait_for_late_ones(spark, tmp_path):
    feed = Feed(spark, tmp_path, late="2 hours")
    first = [("a", at(0), 1), ("a", at(5), 2), ("a", at(6), 3)]
    got = feed(first)
    assert got == {("a", at(0), 1, 0, 0)}  # the watermark stands at 4
    second = [("a", at(4.5), 4), ("a", at(1), 5), ("a", at(9), 6)]
    got = feed(second)
    assert got == brute([*first, second[0]], (1, 3))  # the event at 1 came too late, that at 9 waits
    assert feed.state("waiting") == 1


def test_rows_without_time_are_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    rows = [("a", None, 1), ("a", at(1), None), ("a", at(1), 3), (None, at(1), 4)]
    assert feed(rows) == brute([("a", at(1), 3), (None, at(1), 4)], (1, 3))


def test_setting_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with rocksdb(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before


def test_state_is_written_at_once():
    """A key's calls to its state, each a message to the JVM, do not grow with its seconds."""
    import pandas as pd
    from pyspark.sql import types as T

    from tipline.streaming.trailing import TrailingCounts

    calls = []

    class State:
        def __init__(self, *_):
            self.held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("get", "iterator", "exists"):
                    kept = self.held if self.held is not None else ()
                    return self.held if name == "get" and isinstance(self.held, tuple) else bool(kept) if name == "exists" else iter(kept) if isinstance(kept, list) or self.lists else None
                if name in ("put", "appendList"):
                    self.held = (self.held or [] if name == "appendList" else []) + args[0]
                elif name == "update":
                    self.held = args[0]
                elif name == "clear":
                    self.held = None

            return call

    class Lists(State):
        lists = True

    class Value(State):
        lists = False

    class Handle:
        getListState = getMapState = lambda self, *_: Lists()
        getValueState = lambda self, *_: Value()
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")

    class Now:
        getCurrentWatermarkInMs = lambda self: 1_000_000

    p = TrailingCounts((1, 3), T.LongType())
    p.init(Handle())
    list(p.handleInputRows(("a",), iter([pd.DataFrame({"micros": [k * 1_000_000 for k in range(900)], "tie": range(900)})]), None))
    out = pd.concat(p.handleExpiredTimer(("a",), Now(), None))
    assert out["last_1_days"].tolist() == list(range(900)) and len(calls) < 20
