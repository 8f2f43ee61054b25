"""Trailing windows over entities with very long histories.

A window puts all rows of an entity into one task. Here entities with more rows than one task should hold are cut into ranges of time: their rows are dealt out
by key and order, each range gets a halo (the last rows before it, however many ranges these come from), and row frames are worked out range by range. What a
season frame needs of the ranges before is carried over as sums. The tables of ranges grow with the number of ranges, not with the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipline.functions.columns import safe_div
from tipline.operators import windows
from tipline.sources.scratch import staged

#: Rows of an entity in one range, and of all entities that stay whole in one window partition.
MOST_ROWS = 2_000_000
#: Ranges up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_RANGES = 50_000

_POSITION = (1 << 33) - 1


class Ranges:
    """Rows of long entities, dealt out in ranges: _key (the keys as a struct), row (all columns), range, pos (place in the partition)."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], halo: int, most: int):
        counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)
        self.halo, self.total = halo, counts.agg(F.sum("n")).first()[0] or 0
        if not self.total:
            return
        self.number = -(-self.total // most)
        named = self._small(counts.select(F.struct(*keys).alias("_long")))
        tagged = df.select(F.struct(*keys).alias("_key"), F.struct("*").alias("row"))
        same = F.col("_key").eqNullSafe(F.col("_long"))
        self.whole = tagged.join(named, same, "left_anti").select("row.*")
        by = [F.col(f"row.{c}") for c in [*keys, *order]]
        dealt = tagged.join(named, same, "left_semi").repartitionByRange(self.number, *by).sortWithinPartitions(*by)
        # This number consists of the partition's and of the row's place in it.
        at = F.monotonically_increasing_id()
        self.rows = staged(dealt.select("_key", "row", F.shiftright(at, 33).cast("int").alias("range"), at.bitwiseAND(F.lit(_POSITION)).alias("pos")))

    def _small(self, table: DataFrame) -> DataFrame:
        """Broadcast where the number of ranges bounds it: long entities are no more than ranges, and entities by range no more than twice as many."""
        return F.broadcast(table) if self.number <= BROADCAST_RANGES else table

    def _with(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        renamed = table.withColumnsRenamed({"range": "_range", "_key": "_long"})
        return rows.join(self._small(renamed), (F.col("range") == F.col("_range")) & F.col("_key").eqNullSafe(F.col("_long"))).drop("_range", "_long")

    def cut(self, sums: dict[str, Column]) -> DataFrame:
        """All rows in their range, and each once more in every later range that its trailing frames reach into: the columns of the rows, _range, _own (False
        for halo rows), and the given sums over the entity's rows in the ranges before."""
        each = self.rows.groupBy("_key", "range").agg(F.min("pos").alias("low"), F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])
        w = Window.partitionBy("_key").orderBy("range")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), **{k: F.sum(k).over(before) for k in sums}})
        # Every range has a row at least, so a halo reaches no further than that many ranges.
        each = each.withColumn("later", F.collect_list(F.struct("range", "start")).over(w.rowsBetween(1, self.halo)))
        placed = self._with(self.rows, each.select("_key", "range", "low", "start", "later")).withColumn("at", F.col("start") + F.col("pos") - F.col("low"))
        reached = F.filter("later", lambda r: r["start"] <= F.col("at") + self.halo)
        lent = placed.select("_key", "row", F.explode(reached).alias("to")).select("_key", "row", F.col("to.range").alias("range"), F.lit(False).alias("_own"))
        both = self.rows.select("_key", "row", "range", F.lit(True).alias("_own")).unionByName(lent)
        both = self._with(both, each.select("_key", "range", *sums)) if sums else both
        return both.select("row.*", F.col("range").alias("_range"), "_own", *sums)


def over_long(df: DataFrame, keys: list[str], order: list[str], halo: int, add: Callable[[DataFrame, list[str]], DataFrame], most: int = MOST_ROWS) -> DataFrame:
    """add(df, keys), which adds columns from frames of at most halo rows before the current one, for entities of any length.

    The result equals add(df, keys). Order columns are unique within the keys; null keys are an entity. Entities with at most `most` rows stay whole."""
    ranges = Ranges(df, keys, order, halo, most)
    if not ranges.total:
        return add(df, keys)
    return add(ranges.whole, keys).unionByName(add(ranges.cut({}), [*keys, "_range"]).where("_own").drop("_range", "_own"))


def pack(df: DataFrame, metrics: list[str], keys: list[str], order: list[str], spans: tuple[int, ...] = (3, 7), std: int = 7, prefix: str = "", most: int = MOST_ROWS) -> DataFrame:
    """windows.pack() for entities of any length: the season's mean and the number of games go on from the sums of the ranges before."""
    ranges = Ranges(df, keys, order, max(*spans, std), most)
    if not ranges.total:
        return windows.pack(df, metrics, keys, order, spans, std, prefix)
    sums = {f"_{kind}{k}": f(F.col(f"row.{m}")) for k, m in enumerate(metrics) for kind, f in (("sum", F.sum), ("n", F.count))}
    inside = [*keys, "_range"]
    done = windows.pack(ranges.cut(sums), metrics, inside, order, spans, std, prefix)
    w = windows.before(inside, order)
    out = {}
    for k, m in enumerate(metrics):
        own = F.when(F.col("_own"), F.col(m))
        total, n = (F.coalesce(F.col(f"_{c}{k}"), F.lit(0)) + F.coalesce(f(own).over(w), F.lit(0)) for c, f in (("sum", F.sum), ("n", F.count)))
        out[f"{prefix}{m}_season_pre"] = safe_div(total, n)
        if k == 0:
            out[f"{prefix}games_pre"] = n
    done = done.withColumns(out).where("_own").drop("_range", "_own", *sums)
    return windows.pack(ranges.whole, metrics, keys, order, spans, std, prefix).unionByName(done)
