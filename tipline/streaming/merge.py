"""Streams of event files: repeated merges into a table, and counts by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.sources.manifest import Table

#: Works off all that is there now, then stops.
NOW = {"availableNow": True}


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in here keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict):
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def merge_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], score: Column, recent: str, tie: list[str], trigger: dict = NOW):
    """Merges every batch into the table at path; only files that may hold its keys are rewritten. The merge is idempotent, so that a batch may run again after a
    failure. trigger: what DataStreamWriter.trigger takes, such as {"processingTime": "1 minute"} for a feed that is asked again and again."""

    def batch(df: DataFrame, _: int) -> None:
        Table(df.sparkSession, path, keys).append(df, score, recent, tie)

    return _each_batch(stream, batch, checkpoint, trigger)


def window_counts(events: DataFrame, ts: str, kind: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Rows by window and kind; on a stream, late says how long a window waits."""
    events = events.withWatermark(ts, late) if late else events
    return events.groupBy(F.window(ts, width, slide), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off all that is there now, then stops."""
    _each_batch(stream, sink, checkpoint, NOW).awaitTermination()


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], values: list[str], recent: str, tie: str | None = None, trigger: dict = NOW):
    """Keeps the latest value of each column by key; a null never replaces a value. Of equal times the larger tie wins. Idempotent: a batch may run again. Late
    batches win as they come."""
    order = F.struct(recent, tie) if tie else F.col(recent)

    def batch(df: DataFrame, _: int) -> None:
        newest = df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values])
        Table(df.sparkSession, path, keys).upsert(newest)

    return _each_batch(stream, batch, checkpoint, trigger)


_STATE = ("first", "last", "n")


def history_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str, recent: str, trigger: dict = NOW):
    """Per key the first and the latest value with their moments, and the number of rows, over all batches: one row for each key. A row knows the batch that
    it had last and what it was before, so that a batch that runs again counts once."""
    moment = F.struct(F.col(recent).alias("at"), F.col(value).alias("value"))

    def batch(df: DataFrame, number: int) -> None:
        now = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(moment).alias("first"), F.max(moment).alias("last"), F.count("*").alias("n"))
        now = now.withColumn("batch", F.lit(number).cast("long")).withColumn("before", F.when(F.lit(False), F.struct(*_STATE)))

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            o, n = old.alias("o"), new.alias("n")
            both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
            base = F.when(F.col("o.batch") == F.lit(number), F.col("o.before")).otherwise(F.when(F.col("o.batch").isNotNull(), F.struct(*[F.col(f"o.{c}").alias(c) for c in _STATE])))
            met, again = F.col("n.batch").isNotNull(), both.withColumn("_base", base)
            added = {"first": F.least("_base.first", "n.first"), "last": F.greatest("_base.last", "n.last"), "n": F.coalesce("_base.n", F.lit(0)) + F.col("n.n")}
            out = {c: F.when(met, added[c]).otherwise(F.col(f"o.{c}")) for c in _STATE}
            out |= {"batch": F.coalesce("n.batch", "o.batch"), "before": F.when(met, F.col("_base")).otherwise(F.col("o.before"))}
            return again.select(*[F.when(met, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys], *[c.alias(k) for k, c in out.items()])

        Table(df.sparkSession, path, keys).merge(now, combine)

    return _each_batch(stream, batch, checkpoint, trigger)


def movements(history: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's opening and latest value, the movement between them, and the number of rows, from what history_stream() keeps."""
    whole = history.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return whole.select(*keys, F.col("first.value").alias("opening"), F.col("last.value").alias("latest"), (F.col("last.value") - F.col("first.value")).alias("movement"), "n")


def sliding_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str, late: str | None = None) -> DataFrame:
    """Rows by key in windows that overlap; the state of a window goes once the watermark has passed it."""
    events = events.withWatermark(ts, late) if late else events
    return events.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
