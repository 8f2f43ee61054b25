"""Trailing windows over an entity's rows in time order.

Unless a name says otherwise, the current row never takes part ("leak-free"): frames end at the row before it. Order columns must be unique
within the keys. A statistic is null where the frame has fewer values than it needs; missing values do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tipline.functions.columns import clip, safe_div

DAY = 86_400


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def before(keys: list[str], order: list[str], rows: int | None = None) -> WindowSpec:
    """The last so many rows before the current one, or all of them."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def at_least(n: int, c: Column, value: Column, w: WindowSpec) -> Column:
    return F.when(F.count(c).over(w) >= n, value.over(w))


def mean(c: Column, w: WindowSpec, least: int = 1) -> Column:
    return at_least(least, c, F.avg(c), w)


def deviation(c: Column, w: WindowSpec, least: int = 2, sample: bool = False) -> Column:
    return at_least(least, c, (F.stddev_samp if sample else F.stddev_pop)(c), w)


def quantile(c: Column, q: float, w: WindowSpec) -> Column:
    return F.percentile(c, F.lit(q)).over(w)


def ordered_values(c: Column, w: WindowSpec) -> Column:
    """A window's values in order, without nulls: one frame for any number of quantiles."""
    return F.sort_array(F.collect_list(c).over(w))


def quantile_of(values: Column, q: float) -> Column:
    """Between the neighbours, by distance, of an array in order; null if it is empty."""
    at = (F.size(values) - 1) * F.lit(q)
    low, high = (F.get(values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def pack(df: DataFrame, metrics: list[str], keys: list[str], order: list[str], windows: tuple[int, ...] = (3, 7), std: int = 7, prefix: str = "") -> DataFrame:
    """Means of the last rows for each window, the deviation of one, the mean of all earlier rows, and their number."""
    out = {}
    for m in metrics:
        for n in windows:
            out[f"{prefix}{m}_l{n}_pre"] = mean(F.col(m), before(keys, order, n))
        out[f"{prefix}{m}_std_l{std}_pre"] = deviation(F.col(m), before(keys, order, std))
        out[f"{prefix}{m}_season_pre"] = mean(F.col(m), before(keys, order))
    out[f"{prefix}games_pre"] = F.count(metrics[0]).over(before(keys, order))
    return df.withColumns(out)


def slope(df: DataFrame, metric: str, out: str, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Least-squares slope over the values of the frame, counted 1, 2, ... without the missing ones."""
    nth = F.when(F.col(metric).isNotNull(), F.count(metric).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    w = before(keys, order, rows)
    y = F.col(metric)
    return df.withColumn("_nth", nth).withColumn(out, at_least(2, y, F.regr_slope(y, F.col("_nth")), w)).drop("_nth")


def _mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def shift(df: DataFrame, metric: str, out: str, keys: list[str], order: list[str], rows: int, k: int) -> DataFrame:
    """Mean of the last k values less that of the k before; with fewer than 2k values, of the second less the first half."""
    values = F.collect_list(F.col(metric).cast("double")).over(before(keys, order, rows))
    n = F.size("_values")
    cut = F.when(n >= 2 * k, n - k).otherwise(F.floor(n / 2).cast("int"))
    start = F.when(n >= 2 * k, n - 2 * k).otherwise(0)
    late = F.slice(F.col("_values"), cut + 1, F.greatest(n - cut, F.lit(0)))
    early = F.slice(F.col("_values"), start + 1, F.greatest(cut - start, F.lit(0)))
    return df.withColumn("_values", values).withColumn(out, F.when(n >= 2, _mean_of(late) - _mean_of(early))).drop("_values")


def weighted(df: DataFrame, metric: str, weight: str, keys: list[str], order: list[str], rows: int, prefix: str) -> DataFrame:
    """Weighted mean, deviation and effective number; rows count with a value and a weight above 0."""
    w = before(keys, order, rows)
    ok = F.col(metric).isNotNull() & (F.col(weight) > 0)
    v, m = F.when(ok, F.col(metric)), F.when(ok, F.col(weight))
    sw, sv, svv, sww = (F.sum(x).over(w) for x in (m, m * v, m * v * v, m * m))
    out = {
        f"{prefix}_wmean": sv / sw,
        f"{prefix}_wstd": F.when(F.count(v).over(w) >= 2, F.sqrt(F.greatest(svv / sw - (sv / sw) * (sv / sw), F.lit(0.0)))),
        f"{prefix}_neff": sw * sw / (sww + 1e-12),
    }
    return df.withColumns(out)


def weighted_quantile(df: DataFrame, metric: str, weight: str, out: str, keys: list[str], order: list[str], rows: int, q: float) -> DataFrame:
    """The first value, in order of size, at which the running weight reaches q of the whole. The frame has a fixed number of rows, so its list is short."""
    ok = F.col(metric).isNotNull() & (F.col(weight) > 0)
    pairs = F.collect_list(F.when(ok, F.struct(F.col(metric).cast("double").alias("v"), F.col(weight).cast("double").alias("w")))).over(before(keys, order, rows))
    total = F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + p["w"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
    found = F.aggregate("_pairs", start, lambda s, p: F.struct((s["sum"] + p["w"]).alias("sum"), F.when(s["v"].isNull() & (s["sum"] + p["w"] >= q * F.col("_total")), p["v"]).otherwise(s["v"]).alias("v")))
    return df.withColumn("_pairs", F.array_sort(pairs)).withColumn("_total", total).withColumn(out, found["v"]).drop("_pairs", "_total")


def weighted_trend(df: DataFrame, metric: str, weight: str, keys: list[str], order: list[str], rows: int, k: int, prefix: str) -> DataFrame:
    """Weighted least-squares slope over the frame's rows with a value and a weight above 0, counted 1, 2, ...; and the weighted mean of the last k of them less
    that of the k before (with fewer than 2k, of the second less the first half). Both are null with fewer than two such rows."""
    ok = F.col(metric).isNotNull() & (F.col(weight) > 0)
    pairs = F.collect_list(F.when(ok, F.struct(F.col(metric).cast("double").alias("v"), F.col(weight).cast("double").alias("w")))).over(before(keys, order, rows))
    n = F.size("_pairs")

    def total(of: Column, f) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda s, p: s + f(p))

    # The rows with their place; frames have a fixed number of rows, so the lists are short.
    placed = F.transform("_pairs", lambda p, i: F.struct(p["v"].alias("v"), p["w"].alias("w"), (i + 1).cast("double").alias("t")))
    sw, st, sv = (total(F.col("_placed"), f) for f in (lambda p: p["w"], lambda p: p["w"] * p["t"], lambda p: p["w"] * p["v"]))
    cov = total(F.col("_placed"), lambda p: p["w"] * (p["t"] - F.col("_t")) * (p["v"] - F.col("_v")))
    var = total(F.col("_placed"), lambda p: p["w"] * (p["t"] - F.col("_t")) * (p["t"] - F.col("_t")))
    cut = F.when(n >= 2 * k, n - k).otherwise(F.floor(n / 2).cast("int"))
    start = F.when(n >= 2 * k, n - 2 * k).otherwise(0)

    def mean_of(a: Column) -> Column:
        return total(a, lambda p: p["w"] * p["v"]) / total(a, lambda p: p["w"])

    early, late = F.slice("_pairs", start + 1, F.greatest(cut - start, F.lit(0))), F.slice("_pairs", cut + 1, F.greatest(n - cut, F.lit(0)))
    df = df.withColumn("_pairs", pairs).withColumn("_placed", placed).withColumns({"_t": st / F.when(sw > 0, sw), "_v": sv / F.when(sw > 0, sw)}).withColumns({"_cov": cov, "_var": var})
    out = {f"{prefix}_wslope": F.when(n >= 2, F.col("_cov") / F.when(F.col("_var") >= 1e-12, F.col("_var"))), f"{prefix}_wshift": F.when(n >= 2, mean_of(late) - mean_of(early))}
    return df.withColumns(out).drop("_pairs", "_placed", "_t", "_v", "_cov", "_var")


def games_within(df: DataFrame, ts: str, keys: list[str], order: list[str], days: tuple[int, ...], strict: bool, prefix: str = "games_last_") -> DataFrame:
    """Rows of the last so many days before each. strict: earlier whole seconds only; else earlier rows, those at the same time included."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    span = Window.partitionBy(*keys).orderBy("_s")
    rows = df.withColumn("_s", seconds)
    if not strict:
        # The frames take in all rows of the same time; those in order from the current one on go.
        rows = rows.withColumn("_after", F.count("_s").over(Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)))
    out = {}
    for n in days:
        count = F.count("_s").over(span.rangeBetween(-n * DAY, -1)) if strict else F.count("_s").over(span.rangeBetween(-n * DAY, 0)) - F.col("_after")
        out[f"{prefix}{n}_days"] = F.when(F.col("_s").isNull(), 0).otherwise(count).cast("long")
    return rows.withColumns(out).drop("_s", "_after")


def rest(df: DataFrame, ts: str, keys: list[str], order: list[str]) -> DataFrame:
    """Days of rest, whether the row before is at most a day and a half ago, and whether two earlier rows at least lie in the last six days."""
    gap = (F.unix_seconds(F.col(ts).cast("timestamp")) - F.lag(F.unix_seconds(F.col(ts).cast("timestamp"))).over(ordered(keys, order))) / DAY
    counted = games_within(df, ts, keys, order, (6,), strict=False, prefix="_within_")
    out = {"days_rest": F.greatest(F.lit(0.0), F.col("_gap") - 1), "back_to_back": F.coalesce(F.col("_gap") <= 1.5, F.lit(False)).cast("long"), "three_in_six": (F.col("_within_6_days") >= 2).cast("long")}
    return counted.withColumn("_gap", gap).withColumns(out).drop("_gap", "_within_6_days")


def recency(df: DataFrame, keys: list[str], order: list[str], scale: float = 5.0, oldest_first: bool = True, out: str = "recency_weight") -> DataFrame:
    """exp(-i / scale), i counted from the oldest row or (oldest_first=False) from the latest one."""
    at = F.row_number().over(ordered(keys, order) if oldest_first else Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn(out, F.exp(-(at - 1) / scale))


def decay(curve: str, games: int = 10) -> tuple[float, ...]:
    """Weights of the latest games, the last one first. smooth: slow over five games, faster after; plateau: full for four; simple: half after five."""
    rules = {
        "smooth": lambda n: 1 - 0.02 * (n - 1) if n <= 5 else max(0.5, 0.75 - 0.05 * (n - 5)),
        "plateau": lambda n: 1.0 if n <= 4 else 0.9 if n == 5 else max(0.5, 1.05 - 0.1 * n),
        "simple": lambda n: 1.0 if n <= 5 else 0.5,
    }
    return tuple(round(rules[curve](n), 6) for n in range(1, games + 1))


def decayed_mean(df: DataFrame, metric: str, keys: list[str], order: list[str], weights: tuple[float, ...]) -> DataFrame:
    """One row per key: mean of the latest rows, weighted by rank from the latest; rows beyond the weights do not count."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    w = F.when(F.col(metric).isNotNull(), F.try_element_at(F.array(*map(F.lit, weights)), F.col("_rank")))
    latest = df.withColumn("_rank", rank).where(F.col("_rank") <= len(weights)).withColumn("_w", w)
    return latest.groupBy(*keys).agg(safe_div(F.sum(F.col("_w") * F.col(metric)), F.sum("_w")).alias(f"{metric}_decayed"))


def movement(df: DataFrame, metric: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Change since the first row."""
    return df.withColumn(out, F.col(metric) - F.first(metric).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(df: DataFrame, metric: str, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the largest fall from an earlier peak, as a share of the peak."""
    peak = F.max(metric).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    fall = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col(metric)) / F.col("_peak")).otherwise(0.0)
    return df.withColumn("_peak", peak).groupBy(*keys).agg(F.max(fall).alias("max_drawdown"))


def schedule(df: DataFrame, day: str, margin: str, rating: str, keys: list[str], order: list[str], rows: int, prefix: str) -> DataFrame:
    """Strength of the last games on earlier days: margins weighted by the opponent's rating (0.5 to 3), quality wins, bad losses, toughness (0 to 100).

    A missing margin adds nothing, but its weight counts; a missing rating counts as 0 in the weight. Rows of one day share the state before it."""
    weight = clip(1 + F.coalesce(F.col(rating), F.lit(0.0)) / 20, 0.5, 3.0)
    w = ordered(keys, order).rowsBetween(-rows + 1, 0)
    wins = F.when((F.col(margin) > 0) & (F.col(rating) > 10), 1).otherwise(0)
    losses = F.when((F.col(margin) < 0) & (F.col(rating) < -5), 1).otherwise(0)
    state = {
        "_margin": F.sum(F.coalesce(F.col(margin), F.lit(0.0)) * weight).over(w) / F.sum(weight).over(w),
        "_wins": F.sum(wins).over(w),
        "_losses": F.sum(losses).over(w),
        "_tough": F.coalesce(clip(50 + F.avg(rating).over(w), 0.0, 100.0), F.lit(100.0)),
    }
    whole = df.withColumns(state).withColumn("_state", F.struct(*state))
    # What held at the end of the last earlier day: the last row of each day, carried to the next day's rows.
    last_of_day = F.last("_state").over(Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first_of_day = F.row_number().over(Window.partitionBy(*keys, day).orderBy(*order)) == 1
    lagged = F.lag("_end").over(ordered(keys, order))
    carried = F.first(F.when(F.col("_first"), F.col("_lagged")), ignorenulls=True).over(Window.partitionBy(*keys, day))
    marked = whole.withColumn("_end", last_of_day).withColumn("_first", first_of_day).withColumn("_lagged", lagged).withColumn("_before", carried)
    out = {f"{prefix}_weighted_margin": ("_margin", 0.0), f"{prefix}_quality_wins": ("_wins", 0), f"{prefix}_bad_losses": ("_losses", 0), f"{prefix}_toughness": ("_tough", 50.0)}
    return marked.withColumns({k: F.coalesce(F.col(f"_before.{c}"), F.lit(d)) for k, (c, d) in out.items()}).drop(*state, "_state", "_end", "_first", "_lagged", "_before")


def home_edge(df: DataFrame, side: str, margin: str, keys: list[str], order: list[str], rows: int, prior: float = 3.0, prior_games: int = 10) -> DataFrame:
    """Home less away margin of the last rows, half of it, drawn to a prior by the smaller number of games on either side and kept within -6 and 8."""
    w = before(keys, order, rows)
    home, away = (F.when(F.col(side) == s, F.col(margin)) for s in ("home", "away"))
    n = F.least(F.count(home).over(w), F.count(away).over(w))
    own = (F.avg(home).over(w) - F.avg(away).over(w)) / 2
    trust = n / (n + F.lit(float(prior_games)))
    return df.withColumn("home_edge", clip(F.when(n > 0, trust * own + (1 - trust) * prior).otherwise(prior), -6.0, 8.0))
