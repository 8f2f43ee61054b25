"""Exact order statistics of many columns at once, without gathering values.

Each pass counts the values of every column in equal bins of the interval that still holds the wanted rank, and keeps the bin that holds it, cut down to the
smallest and largest value in it. A rank is found when these two are one. A pass is one scan with map-side counts: at most BINS rows for each column and rank
are shuffled from a task, and two numbers for each reach the driver.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 2048


def _value(name: str) -> Column:
    """The column as a double; missing and non-finite values are null."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], span: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks (from 0) of each column; span: smallest and largest value of each."""
    found, open_ = {}, {}
    for c, ranks in wanted.items():
        for r in ranks:
            if span[c][0] == span[c][1]:
                found[c, r] = span[c][0]
            else:
                open_[c, r] = (*span[c], r)  # interval and the rank in it
    while open_:
        asks = [(c, r, lo, hi) for (c, r), (lo, hi, _) in open_.items()]
        cells = F.array(*[F.struct(F.lit(k).alias("ask"), _value(c).alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (c, _, lo, hi) in enumerate(asks)])
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        # Halves, so that the width of the widest interval is finite.
        at = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1)).cast("int")
        counts = df.select(F.inline(cells)).where((v >= lo) & (v <= hi)).groupBy("ask", at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("ask").orderBy("bin"))
        rank = F.element_at(F.array(*[F.lit(open_[c, r][2]) for c, r, _, _ in asks]), F.col("ask") + 1)
        hit = counts.withColumn("upto", upto).where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
        for row in hit.select("ask", "low", "high", (F.col("upto") - F.col("n")).alias("before")).collect():
            c, r, _, _ = asks[row.ask]
            rank_in = open_.pop((c, r))[2] - row.before
            if row.low == row.high:
                found[c, r] = row.low
            else:
                open_[c, r] = (row.low, row.high, rank_in)
    return found


def quantiles(df: DataFrame, columns: list[str], q: float = 0.5) -> dict[str, float | None]:
    """The exact quantile of each column, between neighbours by distance; missing and non-finite values do not count, None where nothing is left."""
    if not columns:
        return {}
    row = df.agg(*[f(_value(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    at = {c: (row[f"n_{i}"] - 1) * q for i, c in enumerate(columns) if row[f"n_{i}"]}
    ranks = {c: sorted({floor(x), ceil(x)}) for c, x in at.items()}
    found = order_statistics(df, ranks, {c: (row[f"a_{i}"], row[f"b_{i}"]) for i, c in enumerate(columns)})
    out: dict[str, float | None] = dict.fromkeys(columns)
    for c, x in at.items():
        low, high = found[c, floor(x)], found[c, ceil(x)]
        out[c] = low if low == high else low + (high - low) * (x - floor(x))
    return out
