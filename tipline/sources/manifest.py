"""Tables that a merge rewrites only in part.

A table is a list of Parquet files, the manifest, beside its data. Rows lie in buckets by a hash of their key; a file belongs to one bucket, and its line in the
manifest holds the smallest and largest key and an existence filter (a bitmap of key hashes). A merge looks its keys up in the manifest: files that may hold one of
them are read, merged and written anew, all others keep their names, and new keys go to new files. The new manifest is put in place by the rename of a pointer
(files.replace), so readers see the table before or after. Buckets with many small files are written together; buckets double in number when they get too large.
The number of files stays moderate: a table that asks for small buckets gets MANY_BUCKETS of them, and more only when these hold BUCKET_ROWS rows each.

One writer at a time. Files that neither this manifest nor the one before names are deleted.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipline.operators.joins import best
from tipline.operators.joins import upsert as upserted
from tipline.sources import files

#: Rows of a bucket from which the buckets double, files of a bucket from which they are written together, and files whose lines are broadcast.
BUCKET_ROWS, BUCKET_FILES, BROADCAST_ROWS = 4_000_000, 8, 50_000
#: Buckets beyond which only BUCKET_ROWS counts, and rows that a task writes (of one bucket or of several).
MANY_BUCKETS, TASK_ROWS = 256, 250_000
#: A bitmap has 32,768 bits (what bitmap_construct_agg makes); a file has one for so many rows, at most this many.
ROWS_PER_BITMAP, MOST_BITMAPS = 4_000, 1_024
#: One key of so many is looked up first; the others only in files that these did not hit.
FIRST_LOOKUP = 64

_HASH = "_tipline_hash"


def _hashed(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _bit(h: Column) -> Column:
    """Place of a key in its bitmap: bits of the hash that bucket and bitmap do not use."""
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(32_768))


def _bitmap(h: Column, bitmaps: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), bitmaps).cast("int")


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


class Table:
    """The table at a path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16, bucket_rows: int = BUCKET_ROWS, bucket_files: int = BUCKET_FILES):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.first_buckets, self.bucket_rows, self.bucket_files = buckets, bucket_rows, bucket_files

    @property
    def manifest(self) -> DataFrame | None:
        """file, bucket, buckets (of the whole table), n, low and high (keys as structs), filter (bitmaps)."""
        return files.table(self.spark, f"{self.path}/manifest")

    def _names(self, manifest: DataFrame | None) -> list[str]:
        """One name for each file, as Spark's own file index keeps in the driver."""
        return [] if manifest is None else sorted(r.file for r in manifest.select("file").collect())

    def read(self, schema: T.StructType | None = None) -> DataFrame | None:
        """The table as it is now; a later merge does not change it. An empty table, or None without a schema, where there is none yet."""
        return self._of(self._names(self.manifest), schema)

    def _of(self, names: list[str], schema: T.StructType | None) -> DataFrame | None:
        if names:
            return self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in names])
        return None if schema is None else self.spark.createDataFrame([], schema)

    def touched(self, manifest: DataFrame, new: DataFrame, buckets: int, n_files: int) -> list[str]:
        """Files that may hold a key of new: by bucket, range of keys and existence filter."""
        h = F.col(_HASH)
        asked = new.select(_hashed(self.keys).alias(_HASH), F.struct(*self.keys).alias("_key")).withColumn("bucket", F.pmod(h, F.lit(buckets)).cast("int"))
        lines = manifest.select("bucket", "file", "low", "high", F.size("filter").alias("bitmaps"))
        # Filters stay where they are: (file, bitmap, bit) triples meet single bitmaps, not whole files' filters.
        single = manifest.select("file", F.posexplode("filter").alias("at", "bitmap"))

        def hit(asked: DataFrame, lines: DataFrame) -> list[str]:
            in_range = asked.join(_small(lines, n_files), "bucket").where((F.col("_key") >= F.col("low")) & (F.col("_key") <= F.col("high")))
            wanted = in_range.select("file", _bitmap(h, F.col("bitmaps")).alias("at"), _bit(h).alias("bit")).alias("w")
            s = single.alias("s")
            here = (F.col("s.file") == F.col("w.file")) & (F.col("s.at") == F.col("w.at")) & _is_set(F.col("s.bitmap"), F.col("w.bit"))
            return [r.file for r in s.join(wanted, here, "left_semi").select("file").distinct().collect()]

        # One hit settles a file, so that most files of a large merge are settled by few keys; where none of these hits, every key is looked up.
        found = hit(asked.where(F.pmod(F.shiftrightunsigned(h, 8), F.lit(FIRST_LOOKUP)) == 0), lines)
        if len(found) < n_files:
            found += hit(asked, lines.join(self._files(found), "file", "left_anti"))
        return sorted(found)

    def _files(self, names: list[str]) -> DataFrame:
        return _small(self.spark.createDataFrame([(n,) for n in names], "file string"), len(names))

    def _placed(self, rows: DataFrame, buckets: int, n: int) -> DataFrame:
        """About n rows with their bucket, each bucket in one partition; there are as many partitions as the rows need."""
        tasks = min(buckets, max(self.spark.sparkContext.defaultParallelism, n // TASK_ROWS))
        return rows.withColumn("_bucket", F.pmod(_hashed(self.keys), F.lit(buckets)).cast("int")).repartition(tasks, "_bucket")

    def _written(self, placed: DataFrame, buckets: int) -> tuple[list[str], DataFrame]:
        """Writes rows that lie in their buckets, one file for each bucket (the writer sorts by this number), and returns the files' names and their lines of the manifest."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        placed.write.option("maxRecordsPerFile", 0).partitionBy("_bucket").parquet(path)
        back = self.spark.read.schema(placed.schema).parquet(path)
        names = {int(f.split("/")[-2].removeprefix("_bucket=")): "/".join(f.split("/")[-3:]) for f in back.inputFiles()}
        sizes = [(r["_bucket"], names[r["_bucket"]], max(1, min(-(-r["count"] // ROWS_PER_BITMAP), MOST_BITMAPS))) for r in back.groupBy("_bucket").count().collect()]
        known = self.spark.createDataFrame(sizes, "_bucket int, file string, bitmaps int")
        # One number for file and bitmap, as rows are sorted by what they are grouped by.
        h = F.col(_HASH)
        seen = back.select("_bucket", F.struct(*self.keys).alias("_key"), _hashed(self.keys).alias(_HASH)).join(_small(known.drop("file"), len(sizes)), "_bucket")
        seen = seen.select((F.col("_bucket").cast("long") * MOST_BITMAPS + _bitmap(h, F.col("bitmaps"))).alias("_at"), "_key", _bit(h).alias("bit"))
        each = seen.groupBy("_at").agg(F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"), F.bitmap_construct_agg("bit").alias("bitmap"))
        each = each.withColumn("_bucket", F.expr(f"CAST(_at DIV {MOST_BITMAPS} AS INT)")).withColumn("at", F.expr(f"CAST(_at % {MOST_BITMAPS} AS INT)"))
        made = each.groupBy("_bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.map_from_entries(F.collect_list(F.struct("at", "bitmap"))).alias("m"))
        # A bitmap that no key fell into is all zeros.
        zeros = F.unhex(F.repeat(F.lit("00"), 4096))
        filters = F.transform(F.sequence(F.lit(0), F.col("bitmaps") - 1), lambda i: F.coalesce(F.try_element_at("m", i), zeros)).alias("filter")
        lines = made.join(_small(known, len(sizes)), "_bucket").select("file", F.col("_bucket").alias("bucket"), "n", "low", "high", filters, F.lit(buckets).alias("buckets"))
        return list(names.values()), lines

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, int]:
        """combine(old, new) for the keys of new; old has all rows of the files that may hold them, and its result takes their place.

        combine must keep rows whose keys are not in new as they are, and give the same result again for a batch that was merged already if batches may be
        repeated. Returns the number of files kept, rewritten and written."""
        return self._merge(new, lambda old, rows, placed: placed(combine(old, rows)).sortWithinPartitions("_bucket", *self.keys))

    def _merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> dict[str, int]:
        """merge() for a combine that puts rows into their buckets itself, by the function that it gets."""
        manifest = self.manifest
        known = {} if manifest is None else {r.file: r for r in manifest.select("file", "bucket", "buckets", "n").collect()}
        names, redo = sorted(known), []
        buckets = max((r.buckets for r in known.values()), default=self.first_buckets)
        new = new.persist()
        try:
            n_new = new.count()
            grown = buckets
            while max(n_new, sum(r.n for r in known.values())) > grown * (self.bucket_rows if grown < MANY_BUCKETS else max(self.bucket_rows, BUCKET_ROWS)):
                grown *= 2
            if names and grown == buckets:
                full = Counter(r.bucket for r in known.values())
                redo = sorted({*self.touched(manifest, new, buckets, len(names)), *(n for n in names if full[known[n].bucket] >= self.bucket_files)})
            else:
                buckets, redo = grown, names
            n = n_new + sum(known[f].n for f in redo)
            written, lines = self._written(combine(self._of(redo, self._schema(names, new)), new, lambda rows: self._placed(rows, buckets, n)), buckets)
            gone = set(redo)
            kept = [n for n in names if n not in gone]
            if kept:
                left = manifest.join(self._files(redo), "file", "left_anti")
                lines = left.select(*lines.columns).unionByName(lines)
            files.replace(lines.coalesce(max(1, (len(kept) + len(written)) // 1000)), f"{self.path}/manifest")
        finally:
            new.unpersist()
        self._vacuum({*kept, *written, *names})
        return {"kept": len(kept), "rewritten": len(redo), "written": len(written)}

    def _schema(self, names: list[str], new: DataFrame) -> T.StructType:
        return self._of(names[:1], None).schema if names else new.schema

    def _vacuum(self, named: set[str]) -> None:
        """Deletes folders of data of which neither manifest names a file."""
        alive = {n.split("/")[0] for n in named}
        at, fs = files._hadoop(self.spark, f"{self.path}/data")
        for f in fs.listStatus(at):
            if f.getPath().getName() not in alive:
                fs.delete(f.getPath(), True)

    def append(self, new: DataFrame, score: Column, recent: str, tie: list[str]) -> dict[str, int]:
        """Of one key, the most complete and then most recent row stays."""

        def combine(old: DataFrame, rows: DataFrame, placed: Callable[[DataFrame], DataFrame]) -> DataFrame:
            # The bucket, which the keys decide, is named so that the window needs no other shuffle; last, as the sort is quick if its first column tells most rows apart.
            return best(placed(old.unionByName(rows, allowMissingColumns=True)), [*self.keys, "_bucket"], score, recent, tie)

        return self._merge(new, combine)

    def upsert(self, new: DataFrame) -> dict[str, int]:
        """New values over old ones; a null never replaces a value. Keys of new are distinct."""
        return self.merge(new, lambda old, rows: upserted(old, rows, self.keys))
