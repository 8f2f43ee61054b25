"""Features of two sides that meet: box completion, allowed figures, baselines, gaps, composites and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipline.functions.columns import clip, safe_div
from tipline.operators.quality import leaking

# An average box score, and the points it goes with.
DEFAULT_BOX = {"fgm": 27.0, "fga": 62.0, "tpm": 8.0, "tpa": 22.0, "ftm": 14.0, "fta": 20.0, "orb": 10.0, "drb": 25.0, "tov": 12.0}
DEFAULT_POINTS = 72.0


def completed_box(points: Column, box: dict[str, Column]) -> dict[str, Column]:
    """A box score with field-goal attempts stays, with 0 for what is missing; else the average one, in proportion to the points where there are any."""
    has = F.coalesce(box["fga"], F.lit(0.0)) > 0
    scored = F.coalesce(points, F.lit(0.0)) > 0
    return {k: F.when(has, F.coalesce(c, F.lit(0.0))).when(scored, F.bround(F.round(F.lit(DEFAULT_BOX[k]) * (points / DEFAULT_POINTS), 9), 1)).otherwise(F.lit(DEFAULT_BOX[k])) for k, c in box.items()}


def efficiency(points: Column, poss: Column) -> Column:
    return F.when(poss > 0, points / poss * 100).otherwise(100.0)


def shooting_profile(df: DataFrame, made: dict[str, tuple[str, str]]) -> DataFrame:
    """Percentages of made and tried shots; a column that is there already stays."""
    return df.withColumns({name: safe_div(F.col(m), F.col(a)) for name, (m, a) in made.items() if name not in df.columns})


def allowed_pack(df: DataFrame, metrics: Sequence[str], keys: list[str], order: list[str], lengths: Sequence[int] = (3, 7)) -> DataFrame:
    """What opponents reached against a team in its earlier games: means over the last games and over all. One shuffle for all windows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = {f"{m}_l{n}_pre": F.avg(m).over(w.rowsBetween(-n, -1)) for m in metrics for n in lengths}
    return df.withColumns(out | {f"{m}_season_pre": F.avg(m).over(w.rowsBetween(Window.unboundedPreceding, -1)) for m in metrics})


def history_key(df: DataFrame, key: str, name: str, most: float = 0.98) -> Column:
    """The key as text, unless nearly every row has its own (it names rows, not teams): then the normalised name. One aggregate decides for all rows."""
    k = F.when(F.trim(F.col(key).cast("string")) != "", F.col(key).cast("string"))
    found = df.agg(F.count(k).alias("n"), F.count_distinct(k).alias("kinds")).first()
    return F.col(key).cast("string") if found.n and found.kinds / found.n < most else F.lower(F.trim(F.col(name).cast("string")))


def baseline(df: DataFrame, points: str, net: str, attack: str, keys: list[str], order: list[str], rows: int = 5, league: float = 105.0) -> DataFrame:
    """Of each row's earlier games: mean points allowed, the mean weighted by the opponents' net rating (1 + net / 20, 0.5 to 2), that mean less half of
    how far the opponents' attacks stood above the league's, their spread (5 for one game), and how far the figure can be trusted."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    weight = clip(1 + F.col(net) / 20, 0.5, 2.0)
    n = F.count(points).over(w)
    raw = F.avg(points).over(w)
    weighted = F.coalesce(safe_div(F.sum(F.col(points) * weight).over(w), F.sum(F.when(F.col(points).isNotNull(), weight)).over(w)), raw)
    spread = F.when(n > 1, F.stddev_pop(points).over(w)).when(n == 1, 5.0)
    return df.withColumns({
        "raw_baseline": raw,
        "weighted_baseline": weighted,
        "adjusted_baseline": weighted - (F.avg(attack).over(w) - league) * 0.5,
        "baseline_std": spread,
        "baseline_confidence": F.least(F.lit(1.0), n / 5.0) / (1 + spread / 10),
    })


def versus_expectation(df: DataFrame, actual: str, expected: str, keys: list[str], order: list[str], short: int = 5, long: int = 10, part: float = 0.7) -> DataFrame:
    """How far a team's earlier games went beyond what was expected of them: the last few weigh part, the last more the rest."""
    over = F.col(actual) - F.col(expected)
    w = Window.partitionBy(*keys).orderBy(*order)
    a, b = (F.avg("_over").over(w.rowsBetween(-n, -1)) for n in (short, long))
    return df.withColumn("_over", over).withColumn("form", part * a + (1 - part) * b).drop("_over")


def differences(pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    return {name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()}


def gaps(columns: Sequence[str], home: str = "_home", away: str = "_away") -> dict[str, Column]:
    """Ten gaps between the home and the away side; a gap whose inputs the table lacks is null."""
    def c(name: str, end: str) -> Column:
        return F.col(name + end) if name + end in columns else F.lit(None).cast("double")

    def ahead(name: str) -> Column:
        return c(name, home) - c(name, away)

    return {
        "tempo_gap_l7": ahead("pace_l7_pre"),
        "shot_quality_gap_l7": ahead("efg_l7_pre"),
        "turnover_gap_l7": -ahead("tov_pct_l7_pre"),
        "rebound_gap_l7": (c("orb_pct_l7_pre", home) - c("drb_pct_l7_pre", away)) - (c("orb_pct_l7_pre", away) - c("drb_pct_l7_pre", home)),
        "ftr_gap_l7": ahead("ftr_l7_pre"),
        "three_rate_gap_l7": ahead("3par_l7_pre"),
        "netrtg_gap_l7": ahead("netrtg_l7_pre"),
        "rest_gap_3d": -ahead("games_last_3_days"),
        "rest_gap_7d": -ahead("games_last_7_days"),
        "style_distance_l7": (c("style_distance_l7", home) + c("style_distance_l7", away)) / 2,
    }


def plus(own: dict[str, Column], allowed: dict[str, Column]) -> dict[str, Column]:
    """Own figures above what the opponent usually allows; for turnovers, below what it usually forces."""
    return {f"{k}_plus": allowed[k] - c if k == "tov" else c - allowed[k] for k, c in own.items()}


def extra_possessions(orb: Column, opp_orb: Column, tov: Column, opp_tov: Column, poss: Column) -> dict[str, Column]:
    epi = (orb - opp_orb) - (tov - opp_tov)
    return {"epi": epi, "epi_per100": safe_div(epi * 100, poss)}


def composites(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Sums of z-scores over the whole table (population deviation; 0 where a column does not vary). columns: efg, ftr, tov, three, fta100, orb to names.

    The means and deviations are one aggregate of fixed size."""
    stats = df.agg(*[f(F.col(c)).alias(f"{n}_{k}") for k, c in columns.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {}
    for k, c in columns.items():
        mean, deviation = stats[f"m_{k}"], stats[f"s_{k}"]
        z[k] = (F.col(c) - F.lit(mean)) / F.lit(deviation) if deviation else F.when(F.col(c).isNotNull(), 0.0)
    return df.withColumns({"triangle": z["efg"] + z["ftr"] - z["tov"], "moi": z["three"] + z["ftr"] - z["tov"], "rim_proxy": z["fta100"] + z["orb"], "pwr": z["orb"] - z["tov"]})


def fit(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """How side a's strengths meet what side b allows; the last is the sum of the first three."""
    shooting, turnovers, glass = a["efg"] - b["efg"], b["tov"] - a["tov"], a["orb"] - b["orb"]
    return {"shooting_fit": shooting, "turnover_fit": turnovers, "glass_fit": glass, "ftr_fit": a["ftr"] - b["ftr"], "fit3": shooting + turnovers + glass}


def volatility_composites(three: Column, three_std: Column, efg_std: Column, net_std: Column) -> dict[str, Column]:
    return {"shoot_vol": three * three_std, "three_vol_risk": three * (three_std + 0.5 * efg_std), "consistency": 1 / (1 + net_std)}


def differentials(own: dict[str, Column], opp: dict[str, Column]) -> dict[str, Column]:
    """A game's figures less the opponent's, positive where they favour the team. own and opp: orb_pct, drb_pct, ftr, efg, ts_pct, tov_pct."""
    names = {"oreb_diff": "orb_pct", "dreb_diff": "drb_pct", "ftr_diff": "ftr", "efg_diff": "efg", "ts_diff": "ts_pct"}
    return {k: own[c] - opp[c] for k, c in names.items()} | {"to_diff": opp["tov_pct"] - own["tov_pct"]}


def edges(recent: dict[str, Column], allowed: dict[str, Column]) -> dict[str, Column]:
    """A team's recent figures above what the next opponent allows; for turnovers, what the opponent forces above what the team commits."""
    return {f"{k}_edge_pre": allowed[k] - c if k == "tov" else c - allowed[k] for k, c in recent.items()}


def recency_by_days(age: Column, scale: float = 14.0) -> Column:
    return F.exp(-age / scale)


def feature_matrix(df: DataFrame, event: str, side: str, features: Sequence[str], target: Column, keep: Sequence[str] = (), least_present: float = 0.0) -> tuple[DataFrame, list[str]]:
    """One row per event with exactly two sides: both sides' features, their differences and the target; and the names of the features.

    Only names that end in _pre are features, none that hints at the result. Features present in no more than least_present of the rows, or that do not
    vary, are left out; rows without a target go. Sides meet in one aggregation; one more aggregate of fixed size checks all features."""
    names = [f for f in features if f.endswith("_pre")]
    if bad := leaking([f.removesuffix("_pre") for f in names]):
        raise ValueError(f"features that hint at the result: {bad}")
    parts = [F.max(F.when(F.col(side) == s, F.struct(*names, *keep))).alias(p) for s, p in (("home", "h"), ("away", "a"))]
    both = df.groupBy(event).agg(F.count("*").alias("_n"), *parts).where("_n = 2 AND h IS NOT NULL AND a IS NOT NULL")
    flat = both.select(event, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ha" for c in (*names, *keep)])
    flat = flat.withColumns({f"diff_{c}": F.col(f"h_{c}") - F.col(f"a_{c}") for c in names}).withColumn("target", target).where("target IS NOT NULL")
    all_names = [f"{p}_{c}" for c in names for p in ("h", "a", "diff")]
    found = flat.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in all_names for k, f in (("c", F.count), ("lo", F.min), ("hi", F.max))]).first()
    kept = [c for c in all_names if found.n and found[f"c_{c}"] / found.n > least_present and found[f"lo_{c}"] != found[f"hi_{c}"]]
    return flat.select(event, "target", *kept), kept


def merge_diagnostics(df: DataFrame, event: str, ok: str, prefix: str = "opp_", suffix: str = "_pre") -> DataFrame:
    """One row: share of rows with an opponent, share of events with two rows, mean share of opponent features present."""
    columns = [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]
    present = sum((F.col(c).isNotNull().cast("double") for c in columns), F.lit(0.0)) / max(1, len(columns))
    events = df.groupBy(event).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(ok), F.lit(False)).cast("double")).alias("ok"), F.sum(present).alias("present"))
    return events.agg(
        F.coalesce(F.sum("ok") / F.sum("n"), F.lit(0.0)).alias("join_rate"),
        F.coalesce(F.avg((F.col("n") == 2).cast("double")), F.lit(0.0)).alias("symmetric_events"),
        F.coalesce(F.sum("present") / F.sum("n"), F.lit(0.0)).alias("avg_opp_features"),
    )
