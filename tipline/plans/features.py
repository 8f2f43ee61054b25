"""Queries over team games: cleaning, windows, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.functions import basketball as B
from tipline.functions import columns as C
from tipline.functions import text as X
from tipline.operators import aggregates as A
from tipline.operators import joins as J
from tipline.operators import long_windows as LW
from tipline.operators import windows as W
from tipline.plans.adapter import ORDER, TG, team_games
from tipline.plans.registry import query

KEYS = ["team_id"]
ID = ["game_id", "home_away"]
R = C.rounded


def _over(rows: int | None, keys: str = "team_id") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY game_dt, game_id, home_away ROWS BETWEEN {'UNBOUNDED' if rows is None else rows} PRECEDING AND 1 PRECEDING)"


def _r(sql: str) -> str:
    return f"round({sql} + 3e-10, 6) + 0e0"


def _out(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*ID, *[R(F.col(n)).alias(n) for n in names])


@query(f"""WITH {TG}, r AS (SELECT *, avg(ortg) {_over(7)} AS o7, avg(poss) {_over(7)} AS p7 FROM tg),
e AS (SELECT a.game_id, a.home_away, a.team_id, a.points - b.points AS margin, (a.o7 - b.o7) / 2 AS half, (a.p7 + b.p7) / 2 AS pace FROM r a JOIN r b ON a.game_id = b.game_id AND a.home_away <> b.home_away),
m AS (SELECT game_id, home_away, team_id, margin, 2 * half * pace / 100 AS exp_margin FROM e)
SELECT game_id, home_away, team_id, {_r('margin')} AS margin, {_r('exp_margin')} AS exp_margin, {_r('margin - exp_margin')} AS gps FROM m WHERE exp_margin IS NOT NULL
ORDER BY abs(margin - exp_margin) DESC, game_id, home_away LIMIT 20""")
def flagship_expected_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty games furthest from what both teams' earlier games let expect."""
    rolled = team_games(spark, sf_dir).withColumns({"ortg_pre": W.mean(F.col("ortg"), W.before(KEYS, ORDER, 7)), "pace_pre": W.mean(F.col("poss"), W.before(KEYS, ORDER, 7))})
    both = J.opponent(rolled, "game_id", "home_away", ["points", "ortg_pre", "pace_pre"], [F.desc("game_dt")])
    # The defence is what opponents' attacks did against it: here one figure serves for both sides.
    exp = (F.col("ortg_pre") - F.col("opp_ortg_pre")) * (F.col("pace_pre") + F.col("opp_pace_pre")) / 2 / 100
    m = both.withColumns({"margin": F.col("points") - F.col("opp_points"), "exp_margin": exp}).where("exp_margin IS NOT NULL").withColumn("gps", F.col("margin") - F.col("exp_margin"))
    top = m.orderBy(F.abs("gps").desc(), "game_id", "home_away").limit(20)
    return top.select("game_id", "home_away", "team_id", *[R(F.col(c)).alias(c) for c in ("margin", "exp_margin", "gps")])


_MESSY = """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN ' Home' WHEN 2 THEN 'AWAY ' WHEN 3 THEN 'nan' WHEN 4 THEN '' ELSE NULL END AS side,
CASE l_linenumber WHEN 1 THEN '7.9' WHEN 2 THEN '--' WHEN 3 THEN '' WHEN 4 THEN '-3.2' WHEN 5 THEN 'NaN' ELSE CAST(l_partkey AS VARCHAR({n})) END AS raw,
CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS VARCHAR({n})) || '.0' WHEN 2 THEN 'None' ELSE CAST(l_partkey AS VARCHAR({n})) END AS id,
CASE l_linenumber WHEN 1 THEN 'True' WHEN 2 THEN '1.0' WHEN 3 THEN ' true ' WHEN 4 THEN 'no' WHEN 5 THEN NULL ELSE '1' END AS flag,
CASE l_linenumber WHEN 1 THEN '5-10' WHEN 2 THEN '3/7' WHEN 3 THEN 'x' WHEN 4 THEN NULL WHEN 5 THEN '5-x' WHEN 6 THEN 'y/8' ELSE '4' END AS shots FROM {t}"""


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MESSY.format(n=20, t="{lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query(f"""WITH m AS ({_MESSY.format(n=20, t='lineitem')}) SELECT l_orderkey, l_linenumber,
CASE WHEN raw = 'NaN' THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS number, COALESCE(CAST(trunc(CASE WHEN raw = 'NaN' THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END) AS BIGINT), -1) AS whole,
CASE WHEN lower(trim(side)) IN ('', 'nan', 'none') THEN NULL ELSE lower(trim(side)) END AS side,
CASE lower(trim(side)) WHEN 'home' THEN 'away' WHEN 'away' THEN 'home' END AS other_side,
CASE WHEN lower(id) = 'none' THEN NULL ELSE regexp_replace(id, '\\.0$', '') END AS id,
CASE WHEN regexp_full_match(raw, '\\d+(\\.\\d+)?') AND floor(TRY_CAST(raw AS DOUBLE)) <= 1000 THEN CAST(floor(TRY_CAST(raw AS DOUBLE)) AS BIGINT) END AS ranged FROM m""")
def clean_numeric_ids_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, raw = _messy(spark, sf_dir), F.col("raw")
    return m.select("l_orderkey", "l_linenumber", C.num(raw).alias("number"), C.whole(raw, -1).alias("whole"), C.side(F.col("side")).alias("side"), C.flip(F.col("side")).alias("other_side"), C.norm_id(F.col("id")).alias("id"), C.int_in_range(raw, 1000).alias("ranged"))


@query(f"WITH m AS ({_MESSY.format(n=20, t='lineitem')}) SELECT l_orderkey, l_linenumber, COALESCE(lower(trim(flag)) IN ('true', '1', '1.0'), false) AS flag FROM m")
def clean_bool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messy(spark, sf_dir).select("l_orderkey", "l_linenumber", C.truthy(F.col("flag")).alias("flag"))


@query(f"""WITH m AS ({_MESSY.format(n=20, t='lineitem')}) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN shots IN ('5-10', '5-x') THEN 5 WHEN shots = '3/7' THEN 3 ELSE 0 END AS BIGINT) AS made,
CAST(CASE WHEN shots = '5-10' THEN 10 WHEN shots = '3/7' THEN 7 WHEN shots = 'y/8' THEN 8 ELSE 0 END AS BIGINT) AS att FROM m""")
def parse_made_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.made_attempt(F.coalesce("shots", F.lit("")))
    return _messy(spark, sf_dir).select("l_orderkey", "l_linenumber", s["made"].cast("long").alias("made"), s["att"].cast("long").alias("att"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS amount FROM events")
def json_expand_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), C.first_present(events, ["amount", "value"]).alias("amount"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"type\":\"' || event_type || '\"}' ELSE '{\"type\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}' END AS extra FROM events")
def json_pack_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank extras as compact JSON."""
    pairs = F.map_from_arrays(F.array(F.lit("type"), F.lit("user")), F.array("event_type", F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_json(F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))).alias("extra"))


_METRICS = ("ortg", "poss", "gaps")


@query(f"""WITH {TG} SELECT game_id, home_away, {', '.join(f'{_r(f"avg({m}) {_over(n)}")} AS {m}_l{n}_pre' for m in _METRICS for n in (3, 7))},
{', '.join(f'{_r(f"CASE WHEN count({m}) {_over(7)} >= 2 THEN stddev_pop({m}) {_over(7)} END")} AS {m}_std_l7_pre, {_r(f"avg({m}) {_over(None)}")} AS {m}_season_pre' for m in _METRICS)},
count(ortg) {_over(None)} AS games_pre FROM tg""")
def win_roll_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.pack(team_games(spark, sf_dir), list(_METRICS), KEYS, ORDER)
    return df.select(*ID, "games_pre", *[R(F.col(c)).alias(c) for c in df.columns if c.endswith("_pre") and c != "games_pre"])


#: Rows of one range of the league's history; small enough that the tables at hand are cut, too.
LEAGUE_RANGE = 4000


@query(f"""WITH {TG}, l AS (SELECT *, 1 AS league FROM tg) SELECT game_id, home_away, {', '.join(f'{_r(f"avg({m}) {_over(n, chr(49))}")} AS {m}_l{n}_pre' for m in ("ortg", "gaps") for n in (3, 30))},
{', '.join(f'{_r(f"CASE WHEN count({m}) {_over(30, chr(49))} >= 2 THEN stddev_pop({m}) {_over(30, chr(49))} END")} AS {m}_std_l30_pre, {_r(f"avg({m}) {_over(None, chr(49))}")} AS {m}_season_pre' for m in ("ortg", "gaps"))},
count(ortg) {_over(None, chr(49))} AS games_pre FROM l""")
def win_league_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole league did in the games before: one entity that has all rows, cut into ranges of time."""
    df = LW.pack(team_games(spark, sf_dir).withColumn("league", F.lit(1)), ["ortg", "gaps"], ["league"], ORDER, (3, 30), 30, most=LEAGUE_RANGE)
    return df.select(*ID, "games_pre", *[R(F.col(c)).alias(c) for c in df.columns if c.endswith("_pre") and c != "games_pre"])


@query(f"""WITH {TG} SELECT game_id, home_away, {_r(f"avg(ortg) {_over(7, 'team_id, home_away')}")} AS ha_ortg_l7_pre, count(ortg) {_over(None, 'team_id, home_away')} AS ha_games_pre FROM tg""")
def win_home_away_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.pack(team_games(spark, sf_dir), ["ortg"], ["team_id", "home_away"], ORDER, prefix="ha_")
    return df.select(*ID, R(F.col("ha_ortg_l7_pre")).alias("ha_ortg_l7_pre"), "ha_games_pre")


@query(f"""WITH {TG} SELECT game_id, home_away, {_r(f"avg(CASE WHEN abs(points - 50) < 40 THEN ortg END) {_over(7)}")} AS calm_ortg_l7_pre, count(CASE WHEN abs(points - 50) < 40 THEN ortg END) {_over(7)} AS calm_games_pre FROM tg""")
def win_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means without the games that a filter sets aside; they still take up their place in the window."""
    c, w = F.when(F.abs(F.col("points") - 50) < 40, F.col("ortg")), W.before(KEYS, ORDER, 7)
    return team_games(spark, sf_dir).select(*ID, R(W.mean(c, w)).alias("calm_ortg_l7_pre"), F.count(c).over(w).alias("calm_games_pre"))


@query(f"""WITH {TG} SELECT game_id, home_away, {_r(f'min(gaps) {_over(7)}')} AS lo, {_r(f'max(gaps) {_over(7)}')} AS hi, {_r(f'max(gaps) {_over(7)} - min(gaps) {_over(7)}')} AS span,
{_r(f'quantile_cont(gaps, 0.2) {_over(7)}')} AS p20, {_r(f'quantile_cont(gaps, 0.8) {_over(7)}')} AS p80, {_r(f'quantile_cont(gaps, 0.75) {_over(7)} - quantile_cont(gaps, 0.25) {_over(7)}')} AS iqr FROM tg""")
def win_range_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w = F.col("gaps"), W.before(KEYS, ORDER, 7)
    df = team_games(spark, sf_dir).withColumn("v", W.ordered_values(g, w))
    df = df.withColumns({"lo": F.get("v", F.lit(0)), "hi": F.get("v", F.size("v") - 1), **{f"p{k}": W.quantile_of(F.col("v"), k / 100) for k in (20, 25, 75, 80)}})
    return _out(df.withColumns({"span": F.col("hi") - F.col("lo"), "iqr": F.col("p75") - F.col("p25")}), "lo", "hi", "span", "p20", "p80", "iqr")


@query(f"""WITH {TG}, n AS (SELECT *, count(gaps) OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away ROWS UNBOUNDED PRECEDING) AS nth FROM tg)
SELECT game_id, home_away, {_r(f'CASE WHEN count(gaps) {_over(7)} >= 2 THEN regr_slope(gaps, CASE WHEN gaps IS NOT NULL THEN CAST(nth AS DOUBLE) END) {_over(7)} END')} AS slope FROM n""")
def win_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(W.slope(team_games(spark, sf_dir), "gaps", "slope", KEYS, ORDER, 7), "slope")


@query(f"""WITH {TG}, l AS (SELECT game_id, home_away, list_filter(list(gaps) {_over(7)}, lambda x: x IS NOT NULL) AS v FROM tg)
SELECT game_id, home_away, {_r('CASE WHEN len(v) >= 4 THEN (v[-1] + v[-2]) / 2 - (v[-3] + v[-4]) / 2 WHEN len(v) >= 2 THEN list_avg(v[CAST(floor(len(v) / 2.0) AS BIGINT) + 1:]) - list_avg(v[:CAST(floor(len(v) / 2.0) AS BIGINT)]) END')} AS shift FROM l""")
def win_regime_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(W.shift(team_games(spark, sf_dir), "gaps", "shift", KEYS, ORDER, 7, 2), "shift")


_V, _M = "CASE WHEN gaps IS NOT NULL AND weight > 0 THEN gaps END", "CASE WHEN gaps IS NOT NULL AND weight > 0 THEN weight END"


@query(f"""WITH {TG}, s AS (SELECT game_id, home_away, sum({_M}) {_over(7)} AS sw, sum(({_M}) * gaps) {_over(7)} AS sv, sum(({_M}) * gaps * gaps) {_over(7)} AS svv, sum(({_M}) * weight) {_over(7)} AS sww, count({_V}) {_over(7)} AS n FROM tg)
SELECT game_id, home_away, round(sv / sw + 3e-10, 5) + 0e0 AS gaps_wmean, round(CASE WHEN n >= 2 THEN sqrt(greatest(svv / sw - (sv / sw) * (sv / sw), 0)) END + 3e-10, 4) + 0e0 AS gaps_wstd, round(sw * sw / (sww + 1e-12) + 3e-10, 5) + 0e0 AS gaps_neff FROM s""")
def win_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.weighted(team_games(spark, sf_dir), "gaps", "weight", KEYS, ORDER, 7, "gaps")
    return df.select(*ID, R(F.col("gaps_wmean"), 5).alias("gaps_wmean"), R(F.col("gaps_wstd"), 4).alias("gaps_wstd"), R(F.col("gaps_neff"), 5).alias("gaps_neff"))


@query(f"""WITH {TG}, k AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away) AS rn FROM tg),
p AS (SELECT a.game_id, a.home_away, b.gaps AS v, b.weight AS w, sum(b.weight) OVER (PARTITION BY a.game_id, a.home_away ORDER BY b.gaps, b.weight, b.rn ROWS UNBOUNDED PRECEDING) AS upto, sum(b.weight) OVER (PARTITION BY a.game_id, a.home_away) AS total
  FROM k a JOIN k b ON a.team_id = b.team_id AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 WHERE b.gaps IS NOT NULL AND b.weight > 0)
SELECT k.game_id, k.home_away, {_r('q.v')} AS wp80 FROM k LEFT JOIN (SELECT game_id, home_away, min(v) AS v FROM p WHERE upto >= 0.8e0 * total GROUP BY ALL) q ON k.game_id = q.game_id AND k.home_away = q.home_away""")
def win_weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(W.weighted_quantile(team_games(spark, sf_dir), "gaps", "weight", "wp80", KEYS, ORDER, 7, 0.8), "wp80")


@query(f"""WITH {TG}, k AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away) AS rn FROM tg),
p AS (SELECT a.game_id, a.home_away, b.gaps AS v, b.weight AS w, row_number() OVER (PARTITION BY a.game_id, a.home_away ORDER BY b.rn) AS t, count(*) OVER (PARTITION BY a.game_id, a.home_away) AS n
  FROM k a JOIN k b ON a.team_id = b.team_id AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 WHERE b.gaps IS NOT NULL AND b.weight > 0),
q AS (SELECT *, CASE WHEN n >= 4 THEN n - 2 ELSE n // 2 END AS cut, CASE WHEN n >= 4 THEN n - 4 ELSE 0 END AS low FROM p),
r AS (SELECT game_id, home_away, (sum(w * t * v) - sum(w * t) * sum(w * v) / sum(w)) / (sum(w * t * t) - sum(w * t) * sum(w * t) / sum(w)) AS slope,
  sum(CASE WHEN t > cut THEN w * v END) / sum(CASE WHEN t > cut THEN w END) - sum(CASE WHEN t > low AND t <= cut THEN w * v END) / sum(CASE WHEN t > low AND t <= cut THEN w END) AS shift FROM q WHERE n >= 2 GROUP BY ALL)
SELECT k.game_id, k.home_away, round(slope + 3e-10, 5) + 0e0 AS gaps_wslope, round(shift + 3e-10, 5) + 0e0 AS gaps_wshift FROM k LEFT JOIN r ON k.game_id = r.game_id AND k.home_away = r.home_away""")
def win_weighted_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.weighted_trend(team_games(spark, sf_dir), "gaps", "weight", KEYS, ORDER, 7, 2, "gaps")
    return df.select(*ID, R(F.col("gaps_wslope"), 5).alias("gaps_wslope"), R(F.col("gaps_wshift"), 5).alias("gaps_wshift"))


@query(f"""WITH {TG} SELECT game_id, home_away, {', '.join(f'{_r(f"CASE WHEN count(ortg) {_over(n)} >= 3 THEN avg(ortg) {_over(n)} END")} AS m{n}, {_r(f"CASE WHEN count(ortg) {_over(n)} >= 3 THEN stddev_samp(ortg) {_over(n)} END")} AS s{n}' for n in (3, 5, 10))} FROM tg""")
def win_multi_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several windows at once, with at least three values and the sample deviation."""
    out = {}
    for n in (3, 5, 10):
        w = W.before(KEYS, ORDER, n)
        out |= {f"m{n}": W.mean(F.col("ortg"), w, 3), f"s{n}": W.deviation(F.col("ortg"), w, 3, sample=True)}
    return _out(team_games(spark, sf_dir).withColumns(out), *out)


def _within(days: int, strict: bool) -> str:
    tie = "b.s < a.s" if strict else "(b.s < a.s OR b.s = a.s AND (b.game_dt, b.game_id, b.home_away) < (a.game_dt, a.game_id, a.home_away))"
    return f"count(CASE WHEN b.s >= a.s - {days * 86400} AND {tie} THEN 1 END) AS games_last_{days}_days"


def _time_sql(strict: bool) -> str:
    return f"""WITH {TG}, t AS (SELECT *, CAST(floor(epoch(game_dt)) AS BIGINT) AS s FROM tg) SELECT a.game_id, a.home_away, {', '.join(_within(d, strict) for d in (3, 7, 10))}
FROM t a LEFT JOIN t b ON a.team_id = b.team_id AND b.s BETWEEN a.s - 864000 AND a.s GROUP BY a.game_id, a.home_away"""


@query(_time_sql(False))
def win_time_counts_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.games_within(team_games(spark, sf_dir), "game_dt", KEYS, ORDER, (3, 7, 10), strict=False).select(*ID, *[f"games_last_{d}_days" for d in (3, 7, 10)])


@query(_time_sql(True))
def win_time_counts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.games_within(team_games(spark, sf_dir), "game_dt", KEYS, ORDER, (3, 7, 10), strict=True).select(*ID, *[f"games_last_{d}_days" for d in (3, 7, 10)])


_LAG = "(floor(epoch(game_dt)) - lag(floor(epoch(game_dt))) OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away)) / 86400e0"


@query(f"""WITH {TG}, t AS (SELECT *, CAST(floor(epoch(game_dt)) AS BIGINT) AS s FROM tg), g AS (SELECT game_id, home_away, {_LAG} AS gap FROM tg),
c AS (SELECT a.game_id, a.home_away, count(CASE WHEN b.s >= a.s - 518400 AND (b.game_dt, b.game_id, b.home_away) < (a.game_dt, a.game_id, a.home_away) THEN 1 END) AS n FROM t a LEFT JOIN t b ON a.team_id = b.team_id AND b.s BETWEEN a.s - 518400 AND a.s GROUP BY ALL)
SELECT game_id, home_away, {_r('CASE WHEN gap IS NULL THEN 0 ELSE greatest(0e0, gap - 1) END')} AS days_rest, CAST(COALESCE(gap <= 1.5, false) AS BIGINT) AS back_to_back, CAST(n >= 2 AS BIGINT) AS three_in_six FROM g JOIN c USING (game_id, home_away)""")
def win_rest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rest(team_games(spark, sf_dir), "game_dt", KEYS, ORDER).select(*ID, R(F.col("days_rest")).alias("days_rest"), "back_to_back", "three_in_six")


@query(f"WITH {TG} SELECT game_id, home_away, {_r('exp(-(row_number() OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away) - 1) / 5e0)')} AS recency_weight FROM tg")
def win_recency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(W.recency(team_games(spark, sf_dir), KEYS, ORDER), "recency_weight")


@query(f"WITH {TG} SELECT game_id, home_away, {_r('points - first_value(points) OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away)')} AS moved FROM tg")
def win_line_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(W.movement(team_games(spark, sf_dir), "points", KEYS, ORDER, "moved"), "moved")


@query(f"""WITH {TG}, r AS (SELECT game_id, home_away, CASE WHEN count(points) {_over(10)} >= 2 THEN stddev_samp(points) {_over(10)} END AS vol, avg(points) {_over(10)} AS m FROM tg)
SELECT game_id, home_away, {_r('vol')} AS volatility, {_r('vol / nullif(abs(m), 0)')} AS cv FROM r""")
def win_volatility_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.before(KEYS, ORDER, 10)
    df = team_games(spark, sf_dir).withColumns({"volatility": W.deviation(F.col("points"), w, 2, sample=True), "m": W.mean(F.col("points"), w)})
    return _out(df.withColumn("cv", C.safe_div(F.col("volatility"), F.abs("m"))), "volatility", "cv")


@query(f"""WITH {TG} SELECT game_id, home_away, {_r("CASE WHEN count(points) OVER w >= 5 THEN avg(CASE WHEN points > 50 THEN 1e0 ELSE 0e0 END) OVER w END")} AS hit_rate, {_r("sum(points - 50) OVER c")} AS total FROM tg
WINDOW w AS (PARTITION BY team_id ORDER BY game_dt, game_id, home_away ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), c AS (PARTITION BY team_id ORDER BY game_dt, game_id, home_away ROWS UNBOUNDED PRECEDING)""")
def win_hit_rate_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of hits in the last twenty rows, the current one included, and the running total."""
    w = W.ordered(KEYS, ORDER)
    hit = W.at_least(5, F.col("points"), F.avg(F.when(F.col("points") > 50, 1.0).otherwise(0.0)), w.rowsBetween(-19, 0))
    return _out(team_games(spark, sf_dir).withColumns({"hit_rate": hit, "total": F.sum(F.col("points") - 50).over(w.rowsBetween(W.Window.unboundedPreceding, 0))}), "hit_rate", "total")


@query(f"""WITH {TG}, p AS (SELECT team_id, points, max(points) OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away ROWS UNBOUNDED PRECEDING) AS peak FROM tg)
SELECT team_id, {_r('max(CASE WHEN peak > 0 THEN (peak - points) / peak ELSE 0 END)')} AS max_drawdown FROM p GROUP BY team_id""")
def win_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.drawdown(team_games(spark, sf_dir), "points", KEYS, ORDER).select("team_id", R(F.col("max_drawdown")).alias("max_drawdown"))


_CURVES = {
    "smooth": "CASE WHEN rn <= 5 THEN 1.02e0 - 0.02e0 * rn ELSE greatest(0.5e0, 1e0 - 0.05e0 * rn) END", "plateau": "CASE WHEN rn <= 4 THEN 1e0 WHEN rn = 5 THEN 0.9e0 ELSE greatest(0.5e0, 1.05e0 - 0.1e0 * rn) END",
    "simple": "CASE WHEN rn <= 5 THEN 1e0 ELSE 0.5e0 END",
}


@query(f"""WITH {TG}, k AS (SELECT team_id, gaps, row_number() OVER (PARTITION BY team_id ORDER BY game_dt DESC, game_id DESC, home_away DESC) AS rn FROM tg),
w AS (SELECT team_id, gaps, {', '.join(f'CASE WHEN gaps IS NOT NULL THEN {e} END AS {n}' for n, e in _CURVES.items())} FROM k WHERE rn <= 10) SELECT team_id, {', '.join(f"{_r(f'sum({n} * gaps) / sum({n})')} AS gaps_{n}" for n in _CURVES)} FROM w GROUP BY team_id""")
def win_decay_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the last ten games under three curves of decay."""
    out = None
    for curve in ("smooth", "plateau", "simple"):
        one = W.decayed_mean(team_games(spark, sf_dir), "gaps", KEYS, ORDER, W.decay(curve)).select("team_id", R(F.col("gaps_decayed")).alias(f"gaps_{curve}"))
        out = one if out is None else out.join(one, "team_id")
    return out


@query(f"""WITH {TG}, d AS (SELECT *, CAST(game_dt AS DATE) AS day, CAST(game_id % 31 AS DOUBLE) - 12 AS rating, points - 50 AS margin, row_number() OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away) AS rn FROM tg),
c AS (SELECT a.game_id, a.home_away, a.team_id, (SELECT max(b.rn) FROM d b WHERE b.team_id = a.team_id AND b.day < a.day) AS upto FROM d a)
SELECT c.game_id, c.home_away, {_r('COALESCE(sum(b.margin * least(greatest(1 + b.rating / 20, 0.5), 3)) / sum(least(greatest(1 + b.rating / 20, 0.5), 3)), 0)')} AS sos_weighted_margin,
count(CASE WHEN b.margin > 0 AND b.rating > 10 THEN 1 END) AS sos_quality_wins, count(CASE WHEN b.margin < 0 AND b.rating < -5 THEN 1 END) AS sos_bad_losses,
{_r('CASE WHEN count(b.rating) = 0 THEN 50 ELSE least(greatest(50 + avg(b.rating), 0), 100) END')} AS sos_toughness FROM c LEFT JOIN d b ON b.team_id = c.team_id AND b.rn BETWEEN c.upto - 9 AND c.upto GROUP BY c.game_id, c.home_away""")
def sos_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = team_games(spark, sf_dir).withColumns({"day": F.to_date("game_dt"), "rating": (F.col("game_id") % 31).cast("double") - 12, "margin": F.col("points") - 50})
    out = W.schedule(df, "day", "margin", "rating", KEYS, ORDER, 10, "sos")
    return out.select(*ID, R(F.col("sos_weighted_margin")).alias("sos_weighted_margin"), F.col("sos_quality_wins").cast("long"), F.col("sos_bad_losses").cast("long"), R(F.col("sos_toughness")).alias("sos_toughness"))


@query(f"""WITH {TG}, s AS (SELECT game_id, home_away, avg(CASE WHEN home_away = 'home' THEN points END) {_over(20)} AS h, avg(CASE WHEN home_away = 'away' THEN points END) {_over(20)} AS a,
least(count(CASE WHEN home_away = 'home' THEN points END) {_over(20)}, count(CASE WHEN home_away = 'away' THEN points END) {_over(20)}) AS n FROM tg)
SELECT game_id, home_away, {_r('least(greatest(CASE WHEN n > 0 THEN n / (n + 10e0) * (h - a) / 2 + (1 - n / (n + 10e0)) * 3 ELSE 3 END, -6), 8)')} AS home_edge FROM s""")
def hca_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(W.home_edge(team_games(spark, sf_dir), "home_away", "points", KEYS, ORDER, 20), "home_edge")


@query(f"""WITH {TG}, o AS (SELECT a.*, b.drb AS opp_drb, b.orb AS opp_orb FROM tg a JOIN tg b ON a.game_id = b.game_id AND a.home_away <> b.home_away)
SELECT game_id, home_away, {_r('(fgm + 0.5 * tpm) / fga')} AS efg, {_r('100 * tov / poss')} AS tov_pct, {_r('orb / (orb + opp_drb)')} AS orb_pct, {_r('fta / fga')} AS ftr, {_r('fga + 0.475 * fta - orb + tov + 0.33 * opp_orb')} AS poss_oliver, {_r('points / (2 * (fga + 0.44 * fta))')} AS ts FROM o""")
def metrics_four_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = J.opponent(team_games(spark, sf_dir), "game_id", "home_away", ["drb", "orb"], [F.desc("game_dt")]).where("opp_join_ok")
    c = {n: F.col(n) for n in df.columns}
    four = B.four_factors(c["fgm"], c["fga"], c["tpm"], c["tov"], c["fta"], c["orb"], c["opp_drb"], c["poss"])
    more = {"poss_oliver": B.possessions_oliver(c["fga"], c["fta"], c["orb"], c["tov"], c["opp_orb"]), "ts": B.true_shooting(c["points"], c["fga"], c["fta"])}
    return _out(df.withColumns(four | more), *four, *more)


@query(f"""WITH {TG}, o AS (SELECT a.game_id, a.home_away, a.points - b.points AS margin, a.poss FROM tg a LEFT JOIN tg b ON a.game_id = b.game_id AND a.home_away <> b.home_away)
SELECT game_id, home_away, CAST(COALESCE(abs(margin) >= 18, false) AS BIGINT) AS is_blowout, CAST(poss >= 85 OR poss <= 55 AS BIGINT) AS is_extreme_pace, CAST(COALESCE(abs(margin) >= 18, false) OR poss >= 85 OR poss <= 55 AS BIGINT) AS is_noise FROM o""")
def metrics_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = J.opponent(team_games(spark, sf_dir), "game_id", "home_away", ["points"], [F.desc("game_dt")])
    f = B.flags(F.col("points") - F.col("opp_points"), F.col("poss"))
    return df.withColumns(f).select(*ID, *f)


@query(f"""WITH {TG}, r AS (SELECT *, avg(ortg) {_over(7)} AS o, avg(gaps) {_over(7)} AS d, avg(poss) {_over(7)} AS p FROM tg)
SELECT a.game_id, a.home_away, {_r('(a.o + b.d) / 2')} AS exp_ortg, {_r('(a.d + b.o) / 2')} AS exp_drtg, {_r('(a.p + b.p) / 2')} AS exp_pace, {_r('((a.o + b.d) / 2 - (a.d + b.o) / 2) * ((a.p + b.p) / 2) / 100')} AS exp_margin,
{_r('sqrt(COALESCE((a.o - b.o) * (a.o - b.o), 0) + COALESCE((a.p - b.p) * (a.p - b.p), 0))')} AS style_distance FROM r a JOIN r b ON a.game_id = b.game_id AND a.home_away <> b.home_away""")
def metrics_vs_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.before(KEYS, ORDER, 7)
    df = team_games(spark, sf_dir).withColumns({"o": W.mean(F.col("ortg"), w), "d": W.mean(F.col("gaps"), w), "p": W.mean(F.col("poss"), w)})
    both = J.opponent(df, "game_id", "home_away", ["o", "d", "p"], [F.desc("game_dt")]).where("opp_join_ok")
    c = F.col
    e = B.expected(c("o"), c("d"), c("p"), c("opp_o"), c("opp_d"), c("opp_p")) | {"style_distance": B.style_distance([c("o"), c("p")], [c("opp_o"), c("opp_p")])}
    return _out(both.withColumns(e), *[k for k in e if k != "exp_net"])


@query(f"""WITH {TG}, s AS (SELECT avg(ortg) AS m, stddev_pop(ortg) AS sd, avg(poss) AS pm, stddev_pop(poss) AS psd FROM tg)
SELECT game_id, home_away, round((ortg - m) / sd + 3e-10, 5) + 0e0 AS ortg_z, round(least(greatest(1 + 0.15 * ((ortg - m) / sd), 0.85), 1.25) + 3e-10, 5) + 0e0 AS opp_weight,
round(exp(-(abs((ortg - m) / sd - 0.5) + abs((poss - pm) / psd + 0.5)) / 2) + 3e-10, 5) + 0e0 AS relevance FROM tg, s""")
def metrics_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = A.z_scores(team_games(spark, sf_dir), ["ortg", "poss"])
    out = {"opp_weight": B.opponent_weight(F.col("ortg_z")), "relevance": B.relevance([F.col("ortg_z"), F.col("poss_z")], [0.5, -0.5], 2.0)}
    return z.withColumns(out).select(*ID, *[R(F.col(c), 5).alias(c) for c in ("ortg_z", *out)])


@query(f"WITH {TG} SELECT game_id, home_away, {_r('least(greatest(50 + CASE WHEN game_id % 10 = 0 THEN 40 ELSE 0 END + CASE WHEN game_id % 2 = 0 THEN 10 ELSE 0 END + COALESCE(gaps / 10, 0) + CASE WHEN game_id % 7 = 0 THEN 5 ELSE 0 END, 10), 100)')} AS quality FROM tg")
def metrics_game_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("game_id")
    return _out(team_games(spark, sf_dir).withColumn("quality", B.game_quality(g % 10 == 0, g % 2 == 0, F.col("gaps") / 10, g % 7 == 0)), "quality")


_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '&', ' and ', 'g'), '[^a-z0-9 '']', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NAME} AS name_key, sha256(COALESCE(CAST(p_partkey AS VARCHAR), '') || '|' || COALESCE(p_name, '') || '|' || COALESCE(p_brand, '')) AS row_hash FROM part")
def hash_and_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", X.name_key(F.col("p_name")).alias("name_key"), X.row_hash([F.col("p_partkey"), F.col("p_name"), F.col("p_brand")]).alias("row_hash"))


@query("""SELECT event_id, strftime(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE), '%Y-%m-%d') AS local_date, CAST(year(ts) + CASE WHEN month(ts) >= 7 THEN 1 ELSE 0 END AS BIGINT) AS season FROM events""")
def local_game_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format(X.local_date(F.col("ts")), "yyyy-MM-dd").alias("local_date"), X.season(F.col("ts")).alias("season"))
