"""Grouped summaries: shares, buckets, errors, calibration, normal equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipline.functions.columns import safe_div

BUCKETS = (0.0, 2.0, 5.0, 10.0, 20.0)


def concentration(df: DataFrame, keys: list[str], amount: str, tie: str, top: int = 3) -> DataFrame:
    """Sum of squared shares and share of the largest ones; 0 where the total is 0."""
    part = Window.partitionBy(*keys)
    share = safe_div(F.col(amount), F.sum(amount).over(part), 0.0)
    rank = F.row_number().over(part.orderBy(F.desc_nulls_last(amount), tie))
    ranked = df.withColumn("_share", share).withColumn("_rank", rank)
    return ranked.groupBy(*keys).agg(F.sum(F.col("_share") * F.col("_share")).alias("hhi"), F.sum(F.when(F.col("_rank") <= top, F.col("_share")).otherwise(0.0)).alias(f"top{top}_share"))


def bucket(c: Column, edges: tuple[float, ...] = BUCKETS) -> Column:
    """Label of the right-open interval: 'a-b', 'z+' above the last edge, 'nan' where there is no value or it is too small."""
    out = F.lit("nan")
    for low, high in zip(edges, [*edges[1:], None], strict=True):
        label = f"{low:g}+" if high is None else f"{low:g}-{high:g}"
        out = F.when(c >= low if high is None else (c >= low) & (c < high), label).otherwise(out)
    return out


def bucketed(df: DataFrame, value: str, measures: list[Column], edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """measures by bucket; empty buckets appear, too."""
    labels = [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)] + [f"{edges[-1]:g}+", "nan"]
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "bucket string")
    found = df.groupBy(bucket(F.col(value), edges).alias("bucket")).agg(F.count("*").alias("n"), *measures)
    return F.broadcast(every).join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def errors(pred: str, actual: str) -> list[Column]:
    """Mean absolute and root mean squared error, bias, and share of right winners (draws aside)."""
    e = F.col(pred) - F.col(actual)
    right = F.when(F.col(actual) != 0, (F.signum(pred) == F.signum(actual)).cast("double"))
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(right).alias("winner_accuracy")]


def against_line(pred: str, actual: str, line: str) -> list[Column]:
    """Mean edge over the line and share of won bets; a push or a missing result is no bet."""
    edge, cover = F.col(pred) - F.col(line), F.col(actual) - F.col(line)
    won = F.when((cover != 0) & (edge != 0), (F.signum(edge) == F.signum(cover)).cast("double"))
    return [F.avg(F.abs(edge)).alias("avg_edge"), F.avg(won).alias("hit_rate"), F.count(won).alias("n_bets")]


def roi_110(won: Column) -> Column:
    """Return at -110 of bets that are 1 (won) or 0 (lost); nulls are no bets."""
    return safe_div(F.count_if(won == 1) * 100.0 - F.count_if(won == 0) * 110.0, F.count(won) * 110.0)


def value_scan(df: DataFrame, edge: str, won: str, thresholds: tuple[float, ...] = (0, 1, 2, 3, 4, 5), least: int = 3) -> DataFrame:
    """Bets and return for each least edge, and which one is best among those with enough bets."""
    steps = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    # Each bet is counted once, at the highest threshold that it reaches; running sums from above do the rest.
    reached = F.greatest(*[F.when(F.abs(edge) >= t, float(t)) for t in thresholds], F.lit(None).cast("double"))
    counted = df.where(F.col(won).isNotNull()).groupBy(reached.alias("threshold")).agg(F.count_if(F.col(won) == 1).alias("w"), F.count_if(F.col(won) == 0).alias("l"))
    above = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    sums = F.broadcast(steps).join(counted, "threshold", "left").select("threshold", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in "wl"])
    out = sums.select("threshold", (F.col("w") + F.col("l")).alias("n"), safe_div(F.col("w") * 100.0 - F.col("l") * 110.0, (F.col("w") + F.col("l")) * 110.0).alias("roi"))
    best = F.max_by("threshold", F.when(F.col("n") >= least, F.struct("roi", -F.col("threshold")))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("is_best", F.coalesce(F.col("threshold") == best, F.lit(False)))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Log loss, Brier score and expected calibration error (equal bins, the last one closed) in one pass over the data."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))
    by_bin = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(loss).alias("loss"), F.sum((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(p).alias("p"), F.avg(y).alias("y")
    )
    return by_bin.agg((F.sum("loss") / F.sum("n")).alias("log_loss"), (F.sum("brier") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: share missing, distinct values, mean and longest text length. One pass; no column is read that is not asked for."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("missing"), F.count_distinct(c).alias("n_distinct"), F.avg(F.length(text)).alias("mean_length"), F.max(F.length(text)).cast("long").alias("max_length")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def profile_parts(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """For each part of a table and each column: rows, missing values, bytes, and sketches of distinct values (hll) and of text lengths (kll). They can be kept and
    merged later; a part that changes is sketched again alone."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
    rows = df.select(*parts, F.inline(cells))
    length = F.length("text").cast("long")
    return rows.groupBy(*parts, "column").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("n_missing"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(length).alias("chars"), F.max(length).alias("longest"),
        F.hll_sketch_agg("text", F.lit(14)).alias("distinct"), F.kll_sketch_agg_bigint(length).alias("lengths"),
    )


def merged_profile(parts: DataFrame) -> DataFrame:
    """One row per column from its parts' sketches: share missing, about how many distinct values, mean, about the 95th percentile and largest length, bytes."""
    all_ = parts.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("n", "n_missing", "bytes", "chars")], F.max("longest").alias("longest"), F.hll_union_agg("distinct").alias("d"), F.kll_merge_agg_bigint("lengths").alias("l"))
    return all_.select(
        "column", (F.col("n_missing") / F.col("n")).alias("missing"), F.hll_sketch_estimate("d").alias("n_distinct"), safe_div(F.col("chars"), F.col("n") - F.col("n_missing")).alias("mean_length"),
        F.when(F.col("n") > F.col("n_missing"), F.kll_sketch_get_quantile_bigint("l", F.lit(0.95))).alias("p95_length"), F.col("longest").alias("max_length"), "bytes",
    )


def z_scores(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Distance from the mean in population deviations; 0 where there is no spread. Means come from one small aggregate, not from a window over all rows."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({f"{c}{suffix}": F.when(F.col(f"_s_{c}") < 1e-12, F.col(c) * 0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}).drop(*stats.columns)


def capped(df: DataFrame, amount: str, group: str, most: float, out: str) -> DataFrame:
    """Amounts scaled down so that no group's sum is above most."""
    total = F.sum(amount).over(Window.partitionBy(group))
    return df.withColumn(out, F.when(total > most, F.col(amount) * most / total).otherwise(F.col(amount)))


def normal_equations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The sums of products that ridge regression needs, as rows (i, j, value): 'one' is the constant, 'y' the target. One aggregate row is turned into them."""
    names = ["one", *features, "y"]
    cols = {"one": F.lit(1.0), "y": F.col(target).cast("double")} | {f: F.col(f).cast("double") for f in features}
    entries = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.sum(cols[a] * cols[b]).alias("value")) for k, a in enumerate(names) for b in names[k:]]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
