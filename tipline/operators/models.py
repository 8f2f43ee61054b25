"""Linear models by normal equations, splits, walk-forward folds, calibration and rule cards."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipline.operators.aggregates import normal_equations
from tipline.operators.selection import quantiles


def imputed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Missing values replaced by the column's median (0 where there is none)."""
    medians = {c: v if v is not None else 0.0 for c, v in quantiles(df, columns).items()}
    return df.fillna(medians, columns), medians


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 0.01) -> dict[str, float]:
    """Weights of a ridge regression; the constant ('one') is not penalised, constant features get 0. Only sums of products reach the driver."""
    names = ["one", *features]
    sums = {(r.i, r.j): r.value or 0.0 for r in normal_equations(df.where(F.col(target).isNotNull()), features, target).collect()}
    n = sums["one", "one"]
    if not n:
        return dict.fromkeys(names, 0.0)
    spread = {f: sums[f, f] / n - (sums["one", f] / n) ** 2 for f in features}
    used = ["one", *[f for f in features if spread[f] > 1e-12]]
    a = np.array([[sums.get((i, j), sums.get((j, i))) for j in used] for i in used], float)
    a += penalty * np.diag([0.0] + [1.0] * (len(used) - 1))
    w = np.linalg.solve(a, np.array([sums[i, "y"] for i in used], float))
    return dict.fromkeys(names, 0.0) | dict(zip(used, map(float, w), strict=True))


def linear(weights: dict[str, float], medians: dict[str, float] | None = None) -> Column:
    """The model's score as one expression; a missing feature counts as its median, or 0."""
    terms = [F.coalesce(F.col(f), F.lit((medians or {}).get(f, 0.0))) * F.lit(w) for f, w in weights.items() if f != "one"]
    return reduce(lambda a, b: a + b, terms, F.lit(weights.get("one", 0.0)))


def contributions(df: DataFrame, key: str, weights: dict[str, float], top: int) -> DataFrame:
    """The top features of each row by the size of weight times value; ties by name, descending."""
    parts = F.array(*[F.struct(F.abs(F.coalesce(F.col(f), F.lit(0.0)) * w).alias("size"), F.lit(f).alias("feature"), (F.coalesce(F.col(f), F.lit(0.0)) * w).alias("contribution")) for f, w in weights.items() if f != "one"])
    best = F.slice(F.sort_array(parts, asc=False), 1, top)
    return df.select(key, F.posexplode(best).alias("rank", "c")).select(key, (F.col("rank") + 1).alias("rank"), "c.feature", "c.contribution")


def chronological(df: DataFrame, order: list[str], test: float = 0.2, validation: float = 0.2) -> DataFrame:
    """split: train, val or test by time.

    Rows are numbered within range partitions; only the partitions' sizes meet in one place, so no task holds all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    n_test, n_val = F.bround(F.col("_all") * test), F.bround(F.col("_all") * validation)
    at = F.col("_before") + F.col("_at")
    split = F.when(at >= F.col("_all") - n_test, "test").when(at >= F.col("_all") - n_test - n_val, "val").otherwise("train")
    return ranged.join(F.broadcast(offsets), "_p").withColumn("split", split).drop("_p", "_at", "_before", "_all")


def walk_forward(df: DataFrame, time: str, features: list[str], target: str, cuts: list, penalty: float = 0.01) -> DataFrame:
    """Predictions for each span between two cuts by a model of all earlier rows. cuts: ascending times; their number is a parameter."""
    out = []
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], None], strict=True)):
        past, span = df.where(F.col(time) < F.lit(a)), df.where((F.col(time) >= F.lit(a)) & (F.lit(True) if b is None else F.col(time) < F.lit(b)))
        filled, medians = imputed(past, features)
        out.append(span.withColumn("fold", F.lit(k)).withColumn("prediction", linear(ridge(filled, features, target, penalty), medians)))
    return reduce(DataFrame.unionByName, out)


def _solved(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights from sums of products; place 0 is the constant, which is not penalised; features without spread get 0."""
    n = a[0, 0]
    used = [0, *[k for k in range(1, len(a)) if a[k, k] / n - (a[0, k] / n) ** 2 > 1e-12]] if n else []
    w = np.zeros(len(a))
    if used:
        part = a[np.ix_(used, used)] + penalty * np.diag([0.0] + [1.0] * (len(used) - 1))
        w[used] = np.linalg.solve(part, b[used])
    return w


def walk_forward_report(df: DataFrame, time: str, features: list[str], target: str, cuts: list, penalty: float = 0.01) -> DataFrame:
    """For each span between two cuts and each feature, of the model of all earlier rows: weight, importance (size of the weight times the feature's deviation),
    the span's root mean squared error with all features and without this one.

    Every row is read once: each span's sums of products hold for all later models, for the errors, and for the models without a feature, which are solved from
    the same sums. Missing values are medians of the earlier rows; the sums keep them apart, so that each model puts in its own, and only features that lack
    values are read again for that. Rows without target or time are left out. A model with no earlier rows, or a span without rows, gives nulls."""
    p, whole = len(features), df.where(F.col(target).isNotNull() & F.col(time).isNotNull())
    span = sum(((F.col(time) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    # 1, the values (0 if missing), whether they are missing, and the target: their products give those with any filling.
    parts = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], *[F.col(f).isNull().cast("double") for f in features], F.col(target).cast("double")]
    cells = [(i, j) for i in range(len(parts)) for j in range(i, len(parts))]
    rows = whole.groupBy(span.alias("span")).agg(*[F.sum(parts[i] * parts[j]).alias(f"s{i}_{j}") for i, j in cells]).collect()  # one row for each span
    sums = np.zeros((len(cuts) + 1, len(parts), len(parts)))
    for r in rows:
        for i, j in cells:
            sums[r.span, i, j] = sums[r.span, j, i] = r[f"s{i}_{j}"]
    out, y = [], 2 * p + 1
    for k, cut in enumerate(cuts):
        past, now = sums[: k + 1].sum(0), sums[k + 1]
        lacking = [i for i in range(p) if (past + now)[0, 1 + p + i] > 0]
        medians = quantiles(whole.where(F.col(time) < F.lit(cut)), [features[i] for i in lacking])
        fill = np.zeros((p + 2, len(parts)))
        fill[0, 0] = fill[p + 1, y] = 1.0
        for i, f in enumerate(features):
            fill[1 + i, 1 + i], fill[1 + i, 1 + p + i] = 1.0, medians.get(f) or 0.0
        train, test = fill @ past @ fill.T, fill @ now @ fill.T
        n, m = train[0, 0], test[0, 0]

        def error(used: list[int]) -> tuple[np.ndarray, float | None]:
            w = np.zeros(p + 1)
            w[used] = _solved(train[np.ix_(used, used)], train[used, p + 1], penalty)
            gap = np.append(-w, 1.0)
            return w, float(np.sqrt(max(gap @ test @ gap, 0.0) / m)) if n and m else None

        w, whole_error = error(list(range(p + 1)))
        for i, f in enumerate(features):
            spread = np.sqrt(max(train[1 + i, 1 + i] / n - (train[0, 1 + i] / n) ** 2, 0.0)) if n else None
            out.append((k, f, int(n), int(m), float(w[1 + i]) if n else None, float(abs(w[1 + i]) * spread) if n else None, whole_error, error([j for j in range(p + 1) if j != 1 + i])[1]))
    return df.sparkSession.createDataFrame(out, "fold int, feature string, n_train long, n_test long, weight double, importance double, rmse double, rmse_without double")


def ensemble_grid(df: DataFrame, predictions: list[str], actual: str, steps: int = 10) -> DataFrame:
    """Root mean squared error of every weighting of the predictions (multiples of 1/steps that sum to 1), from one pass of sums of products."""
    names = [*predictions, actual]
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums = df.agg(F.count("*").alias("n"), *cells)
    k = len(predictions)
    grid = df.sparkSession.range(1).select(F.lit(0).alias("_left"))
    for i in range(k - 1):
        used = reduce(lambda a, b: a + b, [F.col(f"_w{j}") for j in range(i)], F.lit(0))
        grid = grid.withColumn(f"_w{i}", F.explode(F.sequence(F.lit(0), F.lit(steps) - used)))
    grid = grid.withColumn(f"_w{k - 1}", F.lit(steps) - reduce(lambda a, b: a + b, [F.col(f"_w{j}") for j in range(k - 1)], F.lit(0)))
    w = [F.col(f"_w{i}") / steps for i in range(k)] + [F.lit(-1.0)]
    square = reduce(lambda a, b: a + b, [(1 if i == j else 2) * w[i] * w[j] * F.col(f"{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)])
    return grid.crossJoin(F.broadcast(sums)).select(*[w[i].alias(f"w_{p}") for i, p in enumerate(predictions)], F.sqrt(F.greatest(square / F.col("n"), F.lit(0.0))).alias("rmse"))


def platt(df: DataFrame, score: str, label: str, bins: int = 200, rounds: int = 50) -> tuple[float, float]:
    """Slope and constant that turn a score into a probability, fitted to at most bins groups of like scores (sums only reach the driver)."""
    edges = df.agg(F.min(score).alias("a"), F.max(score).alias("b")).first()
    if edges.a is None:
        return 1.0, 0.0
    width = (edges.b - edges.a) / bins or 1.0
    rows = df.groupBy(F.floor((F.col(score) - edges.a) / width).alias("k")).agg(F.avg(score).alias("x"), F.avg(label).alias("y"), F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[c] for r in rows], float) for c in ("x", "y", "n"))
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (n * (p - y)) + 1e-3 * w)
    return float(w[0]), float(w[1])


def formula_spread(home: dict[str, Column], away: dict[str, Column], weights: dict[str, float], edge: float, pace: float) -> Column:
    """Home margin from weighted differences per 100 possessions, scaled to the pace, and the home edge."""
    return reduce(lambda a, b: a + b, [F.coalesce(home[k] - away[k], F.lit(0.0)) * w for k, w in weights.items()]) * pace / 100 + edge


def bankrolls(df: DataFrame, p: str, odds: str, simulations: int, start: float = 100.0, stake: float = 0.01, seed: int = 7) -> DataFrame:
    """Final bankroll of each simulation of the bets, staking a fixed share. Draws come from a hash of simulation and bet: reruns agree, and no task holds all bets."""
    draw = F.shiftrightunsigned(F.xxhash64("sim", "bet_id", F.lit(seed)), 11) / float(1 << 53)
    payout = F.when(F.col(odds) > 0, F.col(odds) / 100.0).otherwise(-100.0 / F.col(odds))
    step = F.log(1 + stake * F.when(draw < F.col(p), payout).otherwise(-1.0))
    sims = df.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(simulations))))
    return sims.groupBy("sim").agg((start * F.exp(F.sum(step))).alias("bankroll"))


def variants(df: DataFrame, features: list[str], target: str, least_gap: int = 2) -> DataFrame:
    """One row per pair of features at least least_gap places apart, and per single one: the root mean squared error of the mean of their own straight-line fits.

    All fits and all pairs come from one pass of sums of products; rows that lack a feature or the target are left out."""
    names = [*features, target]
    whole = df.dropna(subset=names)
    means = whole.agg(*[F.avg(c).alias(c) for c in names]).first()
    if means[target] is None:
        return df.sparkSession.createDataFrame([], "a string, b string, rmse double")
    centred = [F.col(c) - F.lit(means[c]) for c in names]
    cells = {(i, j): f"s{i}_{j}" for i in range(len(names)) for j in range(i, len(names))}
    sums = whole.agg(F.count("*").alias("n"), *[F.sum(centred[i] * centred[j]).alias(n) for (i, j), n in cells.items()]).first()
    y = len(features)

    def s(i: int, j: int) -> float:
        return sums[cells[min(i, j), max(i, j)]]

    slope = [s(i, y) / s(i, i) if s(i, i) else 0.0 for i in range(y)]
    out = []
    for i in range(y):
        for j in [i, *range(i + least_gap, y)]:
            a, b = slope[i] / 2, slope[j] / 2
            square = s(y, y) - 2 * (a * s(i, y) + b * s(j, y)) + a * a * s(i, i) + b * b * s(j, j) + 2 * a * b * s(i, j)
            out.append((features[i], features[j], float(np.sqrt(max(square, 0.0) / sums.n))))
    return df.sparkSession.createDataFrame(out, "a string, b string, rmse double")
