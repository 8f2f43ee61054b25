"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one white-space byte, as the query contracts define it; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: What bytes.split() and bytes.translate() treat the same way.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tipline-')}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


#: With this setting Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning_up(spark: SparkSession):
    """For queries whose result lies in the shared folder: nothing reads their shuffle files later."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Lists that note the tables staged meanwhile, innermost last.
_notes: list[list[DataFrame]] = []


@contextmanager
def noting(made: list[DataFrame]):
    """Adds all tables staged in here to made, so that the caller can drop them when nothing reads them any more."""
    _notes.append(made)
    try:
        yield
    finally:
        _notes.pop()


def staged(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read it back. Lineage ends there and survives a lost executor; unlike after checkpoint(),
    the optimiser sees true sizes, so that loops do not compound estimates."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    with _cleaning_up(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in _notes:
        made.append(out)
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of staged tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def unread(tables: list[DataFrame], df: DataFrame) -> list[DataFrame]:
    """Those of the staged tables of which df reads no file."""
    files = df.inputFiles()
    names = {t._staged_at: f"/{t._staged_at.rsplit('/', 1)[-1]}/" for t in tables}  # folders' names are unique; stores write the rest in several ways
    return [t for t in tables if not any(names[t._staged_at] in f for f in files)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_bucket(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def trimmed(run):
    """run(batches) of a mapInArrow, after which the worker gives back the memory that it no longer uses: workers wait for other tasks beside the JVM's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in that column have at most so many bytes, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


#: Bytes of one chunk of an array that tasks build in parts, and tasks whose parts meet in one group at first.
CHUNK, FAN_IN = 131_072, 256


def summed(df: DataFrame, build, combine) -> np.ndarray:
    """An array of fixed size built by every task over its own rows and combined over all tasks in two levels.

    build(batches) gives a task's numpy array (same size and dtype in all tasks); combine(a, b) merges two. The driver gets one array.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = build(batches)
        raw, dtype = array.tobytes(), array.dtype.str
        cuts = range(0, len(raw), CHUNK)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(cuts)), pa.int32()), "dtype": [dtype] * len(cuts), "part": pa.array([zlib.compress(raw[i : i + CHUNK], 1) for i in cuts], pa.binary())})

    def merge(key, table: pa.Table) -> pa.Table:
        dtype = table.column("dtype")[0].as_py()
        total = reduce(combine, (np.frombuffer(zlib.decompress(x), dtype) for x in table.column("part").to_pylist()))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "dtype": [dtype], "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, dtype string, part binary"
    made = df.mapInArrow(parts, schema).withColumn("near", F.floor(F.spark_partition_id() / FAN_IN))
    first = made.groupBy("chunk", "near").applyInArrow(lambda key, t: merge(key, t), schema)
    last = first.groupBy("chunk").applyInArrow(lambda key, t: merge(key, t), schema)
    rows = sorted(last.collect(), key=lambda r: r.chunk)  # one row per chunk: as large as the array, whatever the input
    return np.concatenate([np.frombuffer(zlib.decompress(r.part), r.dtype) for r in rows]) if rows else build(iter(()))


#: log2 of the bits of a bitmap: 2 MB, whatever the input.
BITMAP_BITS = 24


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits set at the top BITMAP_BITS bits of a long column. A later exact join drops what merely shares a bit."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITMAP_BITS)] = True
        return np.packbits(bits)

    return np.unpackbits(summed(hashes.select(F.col(column).cast("long")), build, np.bitwise_or)).astype(bool)


#: Rows up to which a side of a join is broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 50_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a cut or staged table for broadcast if it is small enough. Counts at most that many rows and one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
