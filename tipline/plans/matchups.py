"""Queries over two sides that meet: completion, allowed figures, baselines, gaps, composites and the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipline.functions import basketball as B
from tipline.functions import columns as C
from tipline.operators import joins as J
from tipline.operators import matchups as M
from tipline.operators import windows as W
from tipline.plans.adapter import ORDER, TG, team_games
from tipline.plans.registry import query

KEYS = ["team_id"]
ID = ["game_id", "home_away"]
R = C.rounded
_OPPONENT = ("points", "poss", "ortg", "fgm", "fga", "tpm", "tpa", "fta", "tov", "orb", "drb")
#: Each row with the other side's figures and both sides' rates.
_BOTH = f"""{TG}, o AS (SELECT a.*, {', '.join(f'b.{c} AS opp_{c}' for c in _OPPONENT)} FROM tg a JOIN tg b ON a.game_id = b.game_id AND a.home_away <> b.home_away),
b AS (SELECT *, points - opp_points AS margin, (fgm + 0.5e0 * tpm) / fga AS efg, 100 * tov / poss AS tov_pct, orb / (orb + opp_drb) AS orb_pct, fta / fga AS ftr, tpa / fga AS three, 100 * fta / poss AS fta100, 100 * opp_points / poss AS drtg FROM o)"""


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = J.opponent(team_games(spark, sf_dir), "game_id", "home_away", list(_OPPONENT), [F.desc("game_dt")]).where("opp_join_ok")
    c = {n: F.col(n) for n in ("points", "fgm", "fga", "tpm", "tpa", "fta", "tov", "orb", "poss", "opp_drb", "opp_points")}
    factors = B.four_factors(c["fgm"], c["fga"], c["tpm"], c["tov"], c["fta"], c["orb"], c["opp_drb"], c["poss"])
    return df.withColumns({"margin": c["points"] - c["opp_points"], **factors, "three": c["tpa"] / c["fga"], "fta100": B.per_100(c["fta"], c["poss"]), "drtg": B.per_100(c["opp_points"], c["poss"])})


def _over(rows: int | None, keys: str = "team_id") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY game_dt, game_id, home_away ROWS BETWEEN {'UNBOUNDED' if rows is None else rows} PRECEDING AND 1 PRECEDING)"


def _r(sql: str) -> str:
    return f"round({sql} + 3e-10, 6) + 0e0"


def _out(df: DataFrame, names, keys=ID) -> DataFrame:
    return df.select(*keys, *[R(F.col(n)).alias(n) for n in names])


_BOX = {"fgm": 27, "fga": 62, "tpm": 8, "tpa": 22, "fta": 20, "orb": 10, "drb": 25, "tov": 12}


@query(f"""WITH {TG}, m AS (SELECT * REPLACE (CASE game_id % 5 WHEN 0 THEN 0e0 WHEN 1 THEN NULL ELSE fga END AS fga, CASE WHEN game_id % 3 = 0 THEN NULL ELSE orb END AS orb, CASE WHEN game_id % 10 = 0 THEN NULL ELSE points END AS points) FROM tg),
i AS (SELECT game_id, home_away, {', '.join(f'CASE WHEN coalesce(fga, 0) > 0 THEN coalesce({k}, 0) WHEN coalesce(points, 0) > 0 THEN round_even(round({v} * (points / 72), 9), 1) ELSE {v}e0 END AS {k}' for k, v in _BOX.items())}, points FROM m)
SELECT game_id, home_away, {', '.join(f'{_r(k)} AS {k}' for k in _BOX)}, {_r('CASE WHEN fga + 0.44e0 * fta - orb + tov > 0 THEN points / (fga + 0.44e0 * fta - orb + tov) * 100 ELSE 100e0 END')} AS efficiency FROM i""")
def box_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("game_id")
    df = team_games(spark, sf_dir).withColumns({
        "fga": F.when(g % 5 == 0, 0.0).when(g % 5 == 1, None).otherwise(F.col("fga")), "orb": F.when(g % 3 != 0, F.col("orb")), "points": F.when(g % 10 != 0, F.col("points")),
    })
    done = df.withColumns(M.completed_box(F.col("points"), {k: F.col(k) for k in _BOX}))
    poss = B.possessions(F.col("fga"), F.col("fta"), F.col("orb"), F.col("tov"))
    return _out(done.withColumn("efficiency", M.efficiency(F.col("points"), poss)), [*_BOX, "efficiency"])


@query(f"""WITH {_BOTH}, z AS (SELECT * REPLACE (CASE WHEN game_id % 4 = 0 THEN 0e0 ELSE fga END AS fga, CASE WHEN game_id % 6 = 0 THEN 0e0 ELSE tpa END AS tpa) FROM b)
SELECT game_id, home_away, {_r('CASE WHEN fga = 0 THEN 0.5e0 ELSE (fgm + 0.5e0 * tpm) / fga END')} AS efg, {_r('CASE WHEN poss = 0 THEN 15e0 ELSE 100 * tov / poss END')} AS tov_pct, {_r('CASE WHEN orb + opp_drb = 0 THEN 0.3e0 ELSE orb / (orb + opp_drb) END')} AS orb_pct,
{_r('CASE WHEN fga = 0 THEN 0.7e0 ELSE fta / fga END')} AS ftr, {_r('CASE WHEN tpa <> 0 THEN tpm / tpa END')} AS three_pct, {_r('CASE WHEN fta <> 0 THEN fgm / fta END')} AS ft_pct FROM z""")
def factor_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("game_id")
    df = _both(spark, sf_dir).withColumns({"fga": F.when(g % 4 == 0, 0.0).otherwise(F.col("fga")), "tpa": F.when(g % 6 == 0, 0.0).otherwise(F.col("tpa"))})
    factors = B.four_factors(*[F.col(c) for c in ("fgm", "fga", "tpm", "tov", "fta", "orb", "opp_drb", "poss")])
    df = M.shooting_profile(df.withColumns(factors), {"three_pct": ("tpm", "tpa"), "ft_pct": ("fgm", "fta"), "efg": ("fgm", "fga")})
    return _out(df, ["efg", "tov_pct", "orb_pct", "ftr", "three_pct", "ft_pct"])


_ALLOWED = {"efg_allowed": "(opp_fgm + 0.5e0 * opp_tpm) / opp_fga", "ftr_allowed": "opp_fta / opp_fga", "orb_allowed": "opp_orb / (opp_orb + drb)", "tov_forced": "100 * opp_tov / opp_poss", "def_ppp_allowed": "opp_points / opp_poss"}


@query(f"""WITH {_BOTH}, a AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _ALLOWED.items())} FROM b)
SELECT game_id, home_away, {', '.join(f"{_r(f'avg({m}) {_over(n)}')} AS {m}_{f'l{n}' if n else 'season'}_pre" for m in _ALLOWED for n in (3, 7, None))} FROM a""")
def win_allowed_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    allowed = {
        "efg_allowed": (c("opp_fgm") + 0.5 * c("opp_tpm")) / c("opp_fga"), "ftr_allowed": c("opp_fta") / c("opp_fga"), "orb_allowed": c("opp_orb") / (c("opp_orb") + c("drb")),
        "tov_forced": B.per_100(c("opp_tov"), c("opp_poss")), "def_ppp_allowed": c("opp_points") / c("opp_poss"),
    }
    df = M.allowed_pack(_both(spark, sf_dir).withColumns(allowed), list(allowed), KEYS, ORDER)
    return _out(df, [n for n in df.columns if n.endswith("_pre")])


@query(f"""WITH {TG}, k AS (SELECT *, 'team ' || team_id % 40 AS name FROM tg) SELECT game_id, home_away, CAST(team_id AS VARCHAR) AS stable, name AS unstable,
{', '.join(f"{_r(f'avg(ortg) {_over(n)}')} AS ortg_l{n}_pre" for n in range(3, 13))}, {_r(f"avg(ortg) {_over(5, 'name')}")} AS ortg_name_pre FROM k""")
def win_adaptive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the last 3 to 12 games; the key is the team id, or the team's name where ids name rows."""
    df = team_games(spark, sf_dir).withColumns({"name": F.concat(F.lit(" Team "), (F.col("team_id") % 40).cast("string")), "row": F.concat_ws("-", "game_id", "home_away")})
    df = df.withColumns({"stable": M.history_key(df, "team_id", "name"), "unstable": M.history_key(df, "row", "name")})
    df = M.allowed_pack(df, ["ortg"], ["stable"], ORDER, range(3, 13))
    by_name = M.allowed_pack(df.drop("ortg_season_pre").withColumn("ortg_name", F.col("ortg")), ["ortg_name"], ["unstable"], ORDER, [5])
    by_name = by_name.withColumnRenamed("ortg_name_l5_pre", "ortg_name_pre")
    return _out(by_name, [*[f"ortg_l{n}_pre" for n in range(3, 13)], "ortg_name_pre"], [*ID, "stable", "unstable"])


@query(f"""WITH {_BOTH}, w AS (SELECT *, least(greatest(1 + (opp_ortg - 60) / 20, 0.5e0), 2e0) AS wt FROM b),
s AS (SELECT game_id, home_away, count(opp_points) {_over(5)} AS n, avg(opp_points) {_over(5)} AS raw, sum(opp_points * wt) {_over(5)} / sum(wt) {_over(5)} AS weighted, avg(opp_ortg) {_over(5)} AS att, stddev_pop(opp_points) {_over(5)} AS sd FROM w)
SELECT game_id, home_away, {_r('raw')} AS raw_baseline, {_r('weighted')} AS weighted_baseline, {_r('weighted - (att - 105) * 0.5e0')} AS adjusted_baseline, {_r('CASE WHEN n > 1 THEN sd WHEN n = 1 THEN 5e0 END')} AS baseline_std,
{_r('least(1e0, n / 5) / (1 + CASE WHEN n > 1 THEN sd WHEN n = 1 THEN 5e0 END / 10)')} AS baseline_confidence FROM s""")
def baseline_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _both(spark, sf_dir).withColumn("opp_net", F.col("opp_ortg") - 60)
    out = M.baseline(df, "opp_points", "opp_net", "opp_ortg", KEYS, ORDER)
    return _out(out, ["raw_baseline", "weighted_baseline", "adjusted_baseline", "baseline_std", "baseline_confidence"])


@query(f"""WITH {_BOTH}, x AS (SELECT *, avg(opp_points) {_over(10)} AS gives FROM b),
e AS (SELECT p.*, q.gives AS expected FROM x p JOIN x q ON p.game_id = q.game_id AND p.home_away <> q.home_away), f AS (SELECT *, points - expected AS over_ FROM e),
m AS (SELECT *, 0.7e0 * avg(over_) {_over(5)} + 0.3e0 * avg(over_) {_over(10)} AS form FROM f)
SELECT h.game_id, {_r('h.form')} AS home_form, {_r('a.form')} AS away_form, {_r('(h.expected + h.form) - (a.expected + a.form)')} AS pred_margin, {_r('h.expected + h.form + a.expected + a.form')} AS pred_total FROM m h JOIN m a ON h.game_id = a.game_id AND h.home_away = 'home' AND a.home_away = 'away'""")
def recursive_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's points: what the opponent usually allows, and how far the side usually goes beyond that."""
    gives = M.allowed_pack(_both(spark, sf_dir), ["opp_points"], KEYS, ORDER, [10])
    gives = gives.withColumnRenamed("opp_points_l10_pre", "gives").drop("opp_points_season_pre").select("game_id", "home_away", "game_dt", "team_id", "points", "gives")
    met = J.opponent(gives, "game_id", "home_away", ["gives"], [F.desc("game_dt")]).where("opp_join_ok")
    form = M.versus_expectation(met, "points", "opp_gives", KEYS, ORDER).withColumn("reach", F.col("opp_gives") + F.col("form"))
    g = J.home_away(form, "game_id", "home_away", ["form", "reach"]).withColumns({"home_form": F.col("h_form"), "away_form": F.col("a_form"), "pred_margin": F.col("h_reach") - F.col("a_reach"), "pred_total": F.col("h_reach") + F.col("a_reach")})
    return _out(g, ["home_form", "away_form", "pred_margin", "pred_total"], ["game_id"])


_PRE = {"pace": "poss", "efg": "efg", "tov_pct": "tov_pct", "orb_pct": "orb_pct", "drb_pct": "1 - orb_pct", "ftr": "ftr", "3par": "three", "netrtg": "ortg - drtg"}


@query(f"""WITH {_BOTH}, p AS (SELECT game_id, home_away, {', '.join(f'avg({e}) {_over(7)} AS "{n}"' for n, e in _PRE.items())} FROM b)
SELECT h.game_id, {_r('h.pace - a.pace')} AS tempo_gap_l7, {_r('h.efg - a.efg')} AS shot_quality_gap_l7, {_r('a.tov_pct - h.tov_pct')} AS turnover_gap_l7, {_r('(h.orb_pct - a.drb_pct) - (a.orb_pct - h.drb_pct)')} AS rebound_gap_l7, {_r('h.ftr - a.ftr')} AS ftr_gap_l7,
{_r('h."3par" - a."3par"')} AS three_rate_gap_l7, {_r('h.netrtg - a.netrtg')} AS netrtg_gap_l7, CAST(NULL AS DOUBLE) AS rest_gap_3d, CAST(NULL AS DOUBLE) AS rest_gap_7d, CAST(NULL AS DOUBLE) AS style_distance_l7
FROM p h JOIN p a ON h.game_id = a.game_id AND h.home_away = 'home' AND a.home_away = 'away'""")
def gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the sides; those whose inputs are absent (rest, style) are null."""
    df = _both(spark, sf_dir).withColumns({"pace": F.col("poss"), "drb_pct": 1 - F.col("orb_pct"), "3par": F.col("three"), "netrtg": F.col("ortg") - F.col("drtg")})
    df = M.allowed_pack(df, list(_PRE), KEYS, ORDER, [7])
    both = J.home_away(df, "game_id", "home_away", [f"{n}_l7_pre" for n in _PRE])
    both = both.select("game_id", *[F.col(f"{p}_{n}_l7_pre").alias(f"{n}_l7_pre_{s}") for n in _PRE for p, s in (("h", "home"), ("a", "away"))])
    made = M.gaps(both.columns)
    return _out(both.withColumns(made), list(made), ["game_id"])


_COMPOSED = {"efg": "efg", "ftr": "ftr", "tov": "tov_pct", "three": "three", "fta100": "fta100", "orb": "orb_pct"}


@query(f"""WITH {_BOTH}, a AS (SELECT *, {', '.join(f'avg({m}) {_over(7)} AS {m}_pre' for m in ('efg', 'tov_pct', 'orb_pct', 'ftr'))} FROM b),
z AS (SELECT *, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{k}' for k, c in _COMPOSED.items())} FROM a)
SELECT p.game_id, p.home_away, {_r('p.efg - q.efg_pre')} AS efg_plus, {_r('q.tov_pct_pre - p.tov_pct')} AS tov_plus, {_r('p.orb_pct - q.orb_pct_pre')} AS orb_plus, {_r('p.ftr - q.ftr_pre')} AS ftr_plus, {_r('(p.orb - p.opp_orb) - (p.tov - p.opp_tov)')} AS epi,
{_r('((p.orb - p.opp_orb) - (p.tov - p.opp_tov)) / p.poss * 100')} AS epi_per100, {_r('p.z_efg + p.z_ftr - p.z_tov')} AS triangle, {_r('p.z_three + p.z_ftr - p.z_tov')} AS moi, {_r('p.z_fta100 + p.z_orb')} AS rim_proxy, {_r('p.z_orb - p.z_tov')} AS pwr,
{_r('p.efg_pre - q.efg_pre')} AS shooting_fit, {_r('q.tov_pct_pre - p.tov_pct_pre')} AS turnover_fit, {_r('p.orb_pct_pre - q.orb_pct_pre')} AS glass_fit, {_r('p.ftr_pre - q.ftr_pre')} AS ftr_fit, {_r('(p.efg_pre - q.efg_pre) + (q.tov_pct_pre - p.tov_pct_pre) + (p.orb_pct_pre - q.orb_pct_pre)')} AS fit3
FROM z p JOIN z q ON p.game_id = q.game_id AND p.home_away <> q.home_away""")
def plus_composites_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = {"efg": "efg", "tov": "tov_pct", "orb": "orb_pct", "ftr": "ftr"}
    df = M.allowed_pack(_both(spark, sf_dir), list(four.values()), KEYS, ORDER, [7])
    df = M.composites(df, _COMPOSED).withColumns(M.extra_possessions(*[F.col(c) for c in ("orb", "opp_orb", "tov", "opp_tov", "poss")]))
    df = df.withColumnsRenamed({f"opp_{c}": f"their_{c}" for c in _OPPONENT})
    met = J.opponent(df, "game_id", "home_away", [f"{c}_l7_pre" for c in four.values()], [F.desc("game_dt")]).where("opp_join_ok")
    own, other = ({k: F.col(f"{p}{c}_l7_pre") for k, c in four.items()} for p in ("", "opp_"))
    made = M.plus({k: F.col(c) for k, c in four.items()}, other) | M.fit(own, other)
    return _out(met.withColumns(made), [*made, "epi", "epi_per100", "triangle", "moi", "rim_proxy", "pwr"])


@query(f"""WITH {_BOTH}, v AS (SELECT game_id, home_away, avg(three) {_over(10)} AS t, {', '.join(f'CASE WHEN count({c}) {_over(10)} >= 2 THEN stddev_pop({c}) {_over(10)} END AS s{k}' for k, c in enumerate(('tpm / nullif(tpa, 0)', 'efg', 'ortg - drtg')))} FROM b)
SELECT game_id, home_away, {_r('t * s0')} AS shoot_vol, {_r('t * (s0 + 0.5e0 * s1)')} AS three_vol_risk, {_r('1 / (1 + s2)')} AS consistency FROM v""")
def volatility_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.before(KEYS, ORDER, 10)
    df = _both(spark, sf_dir).withColumns({"three_pct": C.safe_div(F.col("tpm"), F.col("tpa")), "net": F.col("ortg") - F.col("drtg")})
    made = M.volatility_composites(F.avg("three").over(w), W.deviation(F.col("three_pct"), w), W.deviation(F.col("efg"), w), W.deviation(F.col("net"), w))
    return _out(df.withColumns(made), list(made))


@query(f"""WITH {TG}, l AS (SELECT team_id, max(game_dt) AS last FROM tg GROUP BY team_id) SELECT game_id, home_away, {_r('exp(-(epoch_us(last) - epoch_us(game_dt)) / 86400e6 / 14)')} AS weight FROM tg JOIN l USING (team_id)""")
def recency_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = team_games(spark, sf_dir)
    age = (F.unix_micros(F.max(F.col("game_dt").cast("timestamp")).over(Window.partitionBy("team_id"))) - F.unix_micros(F.col("game_dt").cast("timestamp"))) / 86_400e6
    return _out(df.withColumn("weight", M.recency_by_days(age)), ["weight"])


_FEATURES = ("ortg", "efg", "tov_pct")


@query(f"""WITH {_BOTH}, p AS (SELECT *, {', '.join(f'avg({m}) {_over(7)} AS {m}_pre' for m in _FEATURES)} FROM b)
SELECT h.game_id, {_r('h.margin')} AS target, {', '.join(f'{_r(f"h.{m}_pre")} AS h_{m}_l7_pre, {_r(f"a.{m}_pre")} AS a_{m}_l7_pre, {_r(f"h.{m}_pre - a.{m}_pre")} AS diff_{m}_l7_pre' for m in _FEATURES)}
FROM p h JOIN p a ON h.game_id = a.game_id AND h.home_away = 'home' AND a.home_away = 'away'""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.allowed_pack(_both(spark, sf_dir), list(_FEATURES), KEYS, ORDER, [7]).withColumn("flat_l7_pre", F.lit(1.0))
    matrix, names = M.feature_matrix(df, "game_id", "home_away", [*[f"{m}_l7_pre" for m in _FEATURES], "flat_l7_pre"], F.col("h_margin"), ["margin"])
    return _out(matrix, ["target", *names], ["game_id"])


@query(f"""WITH {TG}, f AS (SELECT *, avg(ortg) {_over(7)} AS ortg_pre, avg(gaps) {_over(3)} AS gaps_pre FROM tg WHERE NOT (game_id % 9 = 0 AND home_away = 'away')),
j AS (SELECT p.game_id, q.game_id IS NOT NULL AS ok, q.ortg_pre AS o1, q.gaps_pre AS o2 FROM f p LEFT JOIN f q ON p.game_id = q.game_id AND p.home_away <> q.home_away)
SELECT {_r('avg(CAST(ok AS INTEGER))')} AS join_rate, {_r('(SELECT avg(CASE WHEN n = 2 THEN 1e0 ELSE 0e0 END) FROM (SELECT count(*) AS n FROM j GROUP BY game_id))')} AS symmetric_events,
{_r('avg((CASE WHEN o1 IS NULL THEN 0e0 ELSE 1e0 END + CASE WHEN o2 IS NULL THEN 0e0 ELSE 1e0 END) / 2)')} AS avg_opp_features FROM j""")
def dq_opponent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_sided = team_games(spark, sf_dir).where(~((F.col("game_id") % 9 == 0) & (F.col("home_away") == "away")))
    df = M.allowed_pack(M.allowed_pack(one_sided, ["ortg"], KEYS, ORDER, [7]).drop("ortg_season_pre"), ["gaps"], KEYS, ORDER, [3])
    met = J.opponent(df, "game_id", "home_away", ["ortg_l7_pre", "gaps_l3_pre"], [F.desc("game_dt")])
    found = M.merge_diagnostics(met, "game_id", "opp_join_ok")
    return found.select(*[R(F.col(c)).alias(c) for c in found.columns])
