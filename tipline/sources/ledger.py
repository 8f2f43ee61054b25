"""Work on keys that can be taken up again: what is done, what failed and how often, kept with the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.sources import files


class Ledger:
    """entries(): key, status (done or failed), attempts and the last error; data(): the results of the keys that are done.

    Both are parts of one version, put in place by one rename: a run that is lost half way leaves the state before it, and the next run does the same work again.
    One run at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, most: int = 3):
        self.spark, self.path, self.key, self.most = spark, path, key, most

    def entries(self) -> DataFrame | None:
        return files.table(self.spark, self.path, part="ledger")

    def data(self) -> DataFrame | None:
        return files.table(self.spark, self.path, part="data")

    def pending(self, keys: DataFrame) -> DataFrame:
        """Keys, once each and without null, that are neither done nor failed as often as they may be, with the number of attempts so far."""
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        entries = self.entries()
        if entries is None:
            return asked.withColumn("attempts", F.lit(0).cast("long"))
        known = asked.join(entries.select(self.key, "status", "attempts"), self.key, "left")
        open_ = F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("attempts") < self.most))
        return known.where(open_).select(self.key, F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"))

    def run(self, keys: DataFrame, work: Callable[[DataFrame], DataFrame], at_most: int | None = None) -> int:
        """One attempt at every pending key (or at_most of them, the smallest first); returns how many were tried, 0 when nothing is left to do.

        work gets the keys with their attempts and returns, for each, the key, an error (null: it worked) and its results; a key without a row failed."""
        todo = self.pending(keys)
        todo = (todo if at_most is None else todo.orderBy(self.key).limit(at_most)).persist()
        try:
            n = todo.count()
            if not n:
                return 0
            result = work(todo).persist()
            try:
                ok = result.where("error IS NULL").drop("error")
                tried = todo.join(result.select(self.key, "error", F.lit(True).alias("_there")), self.key, "left")
                failed = F.col("_there").isNull() | F.col("error").isNotNull()
                now = tried.select(self.key, F.when(failed, "failed").otherwise("done").alias("status"), (F.col("attempts") + 1).alias("attempts"), F.when(failed, F.coalesce("error", F.lit("no result"))).alias("error"))
                old, data = self.entries(), self.data()
                entries = now if old is None else old.join(todo.select(self.key), self.key, "left_anti").select(*now.columns).unionByName(now)
                files.replace_all({"ledger": entries, "data": ok if data is None else data.unionByName(ok)}, self.path)
            finally:
                result.unpersist()
            return n
        finally:
            todo.unpersist()
