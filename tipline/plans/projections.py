"""Queries that project games from both sides' earlier games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.functions import columns as C
from tipline.operators import matchups as M
from tipline.operators import projections as P
from tipline.operators import windows as W
from tipline.plans.adapter import ORDER, TG, team_games
from tipline.plans.registry import query

KEYS = ["team_id"]
ID = ["game_id", "home_away"]
R = C.rounded
_BOX = (*P.BOX, "tpa")


def _r(sql: str, places: int = 6) -> str:
    return f"round({sql} + 3e-10, {places}) + 0e0"


def _over(rows: int | None, keys: str = "team_id") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY game_dt, game_id, home_away ROWS BETWEEN {'UNBOUNDED' if rows is None else rows} PRECEDING AND 1 PRECEDING)"


_FACING = f"""{TG}, fc AS (SELECT a.*, {', '.join(f'b.{c} AS opp_{c}' for c in _BOX)} FROM tg a JOIN tg b ON a.game_id = b.game_id AND a.home_away <> b.home_away)"""
_ELEVEN = f"""{_FACING}, pc AS (SELECT *, fga + 0.44e0 * fta - orb + tov AS own_n, ((fga + 0.44e0 * fta - orb + tov) + (opp_fga + 0.44e0 * opp_fta - opp_orb + opp_tov)) / 2 AS pace FROM fc),
bx AS (SELECT game_id, home_away, team_id, game_dt, 100 * points / pace AS ortg, 100 * opp_points / pace AS drtg, 100 * points / pace - 100 * opp_points / pace AS netrtg, pace, (fgm + 0.5e0 * tpm) / fga AS efg, 100 * tov / own_n AS tov_pct,
  orb / (orb + opp_drb) AS orb_pct, drb / (drb + opp_orb) AS drb_pct, fta / fga AS ftr, tpa / fga AS "3par", points / (2 * (fga + 0.44e0 * fta)) AS ts_pct FROM pc)"""


def _pack_sql(prefix: str, keys: str, std: bool = True) -> str:
    cells = []
    for m in P.ELEVEN:
        cells += [f'{_r(f"""avg("{m}") {_over(n, keys)}""", 5)} AS "{prefix}{m}_{name}_pre"' for n, name in ((3, "l3"), (7, "l7"), (None, "season"))]
        if std:
            cells.append(f'{_r(f"""CASE WHEN count("{m}") {_over(7, keys)} >= 2 THEN stddev_pop("{m}") {_over(7, keys)} END""", 5)} AS "{prefix}{m}_std_l7_pre"')
    return ", ".join(cells)


@query(f"WITH {_ELEVEN} SELECT game_id, home_away, {_pack_sql('', 'team_id')}, {_pack_sql('ha_', 'team_id, home_away')} FROM bx")
def win_roll_pack_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core metrics' trailing means and deviations, over all of a team's games and over those on the same side."""
    df = P.eleven(team_games(spark, sf_dir), "game_id", "home_away")
    df = W.pack(df, list(P.ELEVEN), KEYS, ORDER)
    df = W.pack(df, list(P.ELEVEN), [*KEYS, "home_away"], ORDER, prefix="ha_")
    return df.select(*ID, *[R(F.col(f"`{p}{m}_{s}_pre`"), 5).alias(f"{p}{m}_{s}_pre") for p in ("", "ha_") for m in P.ELEVEN for s in ("l3", "l7", "season", "std_l7")])


def _rates(p: str, q: str) -> str:
    return f"""CASE WHEN {p}fga > 0 THEN ({p}fgm + 0.5e0 * {p}tpm) / {p}fga ELSE 0.5e0 END AS {p}r_efg, CASE WHEN {p}pos > 0 THEN {p}tov / {p}pos ELSE 0.15e0 END * 100 AS {p}r_tov,
CASE WHEN {p}orb + {q}drb > 0 THEN {p}orb / ({p}orb + {q}drb) ELSE 0.3e0 END AS {p}r_orb, CASE WHEN {p}drb + {q}orb > 0 THEN {p}drb / ({p}drb + {q}orb) ELSE 0.7e0 END AS {p}r_drb,
CASE WHEN {p}fga > 0 THEN {p}fta / {p}fga ELSE 0.3e0 END AS {p}r_ftr, CASE WHEN {p}pos > 0 THEN 100 * {p}points / {p}pos ELSE 100e0 END AS {p}r_eff"""


_ALLOWED = {"efg": "opp_r_efg", "orb_pct": "opp_r_orb", "ftr": "opp_r_ftr", "off_eff": "opp_r_eff", "tov_pct": "opp_r_tov", "drb_pct": "r_drb", "own_off": "r_eff", "own_def": "opp_r_eff", "margin": "opp_points - points", "total": "opp_points + points"}
_FIGURES = {
    "team_net_eff": ("r_eff - CASE WHEN pos > 0 THEN 100 * opp_points / pos ELSE 100e0 END", 0), "team_pace": ("pos", 70), "team_efg": ("r_efg", 0.5), "team_tov_pct": ("r_tov", 15), "team_orb_pct": ("r_orb", 0.3), "team_drb_pct": ("r_drb", 0.7), "team_ftr": ("r_ftr", 0.3),
    "efg_vs_exp": ("(r_efg - o_efg) * 100", 0), "orb_vs_exp": ("(r_orb - o_orb_pct) * 100", 0), "ftr_vs_exp": ("(r_ftr - o_ftr) * 100", 0), "tov_vs_exp": ("o_tov_pct - r_tov", 0), "drb_vs_exp": ("(r_drb - (1 - o_drb_pct)) * 100", 0), "off_eff_vs_exp": ("r_eff - o_off_eff", 0),
    "opp_quality": ("o_own_off - o_own_def", 0),
}


def _delta(raw: str, versus: str) -> str:
    return f"(0.3e0 * ({raw}) + 0.7e0 * (h.{versus} - a.{versus}))"


@query(f"""WITH {_FACING}, ps AS (SELECT *, fga + 0.475e0 * fta - orb + tov + 0.33e0 * opp_orb AS pos, opp_fga + 0.475e0 * opp_fta - opp_orb + opp_tov + 0.33e0 * orb AS opp_pos FROM fc),
rt AS (SELECT *, {_rates('', 'opp_')}, {_rates('opp_', '')} FROM ps),
bs AS (SELECT *, {', '.join(f'coalesce(avg({c}) {_over(5)}, {P.FIRST_GAME[k]}e0) AS b_{k}' for k, c in _ALLOWED.items())} FROM rt),
mt AS (SELECT x.*, {', '.join(f'y.b_{k} AS o_{k}' for k in _ALLOWED)} FROM bs x JOIN bs y ON x.game_id = y.game_id AND x.home_away <> y.home_away),
ex AS (SELECT game_id, home_away, team_id, game_dt, {', '.join(f'{e} AS {k}' for k, (e, _) in _FIGURES.items())} FROM mt),
mn AS (SELECT game_id, home_away, count(*) {_over(5)} AS n, coalesce(avg(team_net_eff) {_over(5)}, 0) - coalesce(avg(team_net_eff) {_over(10)}, 0) AS drift, {', '.join(f'0.7e0 * coalesce(avg({k}) {_over(5)}, {d}) + 0.3e0 * coalesce(avg({k}) {_over(10)}, {d}) AS {k}' for k, (_, d) in _FIGURES.items())} FROM ex),
ms AS (SELECT h.game_id, (h.team_pace + a.team_pace) / 2 AS pace, 0.3e0 * (h.team_net_eff - a.team_net_eff) + 0.7e0 * (h.off_eff_vs_exp - a.off_eff_vs_exp) AS eff, (h.opp_quality - a.opp_quality) * 0.35e0 AS sos,
  0.28e0 * {_delta('(h.team_efg - a.team_efg) * 100', 'efg_vs_exp')} + 0.22e0 * {_delta('a.team_tov_pct - h.team_tov_pct', 'tov_vs_exp')} + 0.18e0 * {_delta('(h.team_orb_pct - a.team_orb_pct) * 100', 'orb_vs_exp')}
  + 0.16e0 * {_delta('(h.team_drb_pct - a.team_drb_pct) * 100', 'drb_vs_exp')} + 0.16e0 * {_delta('(h.team_ftr - a.team_ftr) * 100', 'ftr_vs_exp')} AS comp,
  0.6e0 * (least(h.n / 5e0, 1) + least(a.n / 5e0, 1)) / 2 + 0.4e0 * (greatest(0, 1 - abs(h.drift) / 20) + greatest(0, 1 - abs(a.drift) / 20)) / 2 AS trust
  FROM mn h JOIN mn a ON h.game_id = a.game_id WHERE h.home_away = 'home' AND a.home_away = 'away')
SELECT game_id, {_r('-((0.6e0 * eff + 0.4e0 * comp) * pace / 70 + sos + 3.2e0)', 5)} AS predicted_spread, {_r('least(0.95e0, trust)', 5)} AS confidence, {_r('pace', 5)} AS pace, {_r('eff', 5)} AS eff_edge, {_r('comp', 5)} AS composite_edge, {_r('sos', 5)} AS sos_factor FROM ms""")
def recursive_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads of all games from what both sides did against what their opponents used to allow."""
    out = P.expected_spreads(team_games(spark, sf_dir), "game_id", "home_away", KEYS, ORDER)
    return out.select("game_id", *[R(F.col(c), 5).alias(c) for c in out.columns if c != "game_id"])


def _b(side: str, m: str) -> str:
    """A metric's blend of season and recent figure."""
    s, n = f'{side}."{m}_season_pre"', f'{side}."{m}_l7_pre"'
    return f"coalesce(0.65e0 * {s} + 0.35e0 * {n}, {s}, {n})"


def _d(side: str, m: str, default: float = 0) -> str:
    return f"coalesce({_b(side, m)}, {default})"


def _trust(swings: float, schedule: float) -> str:
    lacking = " + ".join(f"CASE WHEN {_b('h', m)} IS NULL AND {_b('a', m)} IS NULL THEN 1 ELSE 0 END" for m in P.NEEDED)
    vol = "(coalesce(h.netrtg_std_l7_pre, 0) + coalesce(a.netrtg_std_l7_pre, 0)) / 2 / 10"
    return f"least(greatest(0.88e0 - 0.05e0 * ({lacking}) / 6 - {swings}e0 * least(greatest({vol}, 0), 0.1e0), 0.7e0), 0.97e0)"


def _units(edge: str, conf: str, least_edge: float, least_conf: float) -> str:
    def more(e: float, c: float) -> str:
        return f"abs({edge}) >= {least_edge + e}e0 AND {conf} >= {least_conf}e0 + {c}e0"

    return f"CASE WHEN abs({edge}) >= {least_edge}e0 AND {conf} >= {least_conf}e0 THEN CASE WHEN {more(3.0, 0.05)} THEN 3e0 WHEN {more(1.5, 0.03)} THEN 2e0 ELSE 1e0 END ELSE 0e0 END"


def _side(edge: str, least_edge: float, over: str, under: str) -> str:
    return f"CASE WHEN {edge} >= {least_edge}e0 THEN '{over}' WHEN {edge} <= -{least_edge}e0 THEN '{under}' END"


_PACKED = ", ".join(f'avg("{m}") {_over(n)} AS "{m}_{s}_pre"' for m in (*P.NEEDED, "ortg", "drtg") for n, s in ((7, "l7"), (None, "season")))


def _implied(odds: str) -> str:
    return f"CASE WHEN {odds} > 0 THEN 100 / ({odds} + 100e0) ELSE -{odds} / (100e0 - {odds}) END"


@query(f"""WITH {_ELEVEN}, pk AS (SELECT game_id, home_away, {_PACKED}, CASE WHEN count(netrtg) {_over(7)} >= 2 THEN stddev_pop(netrtg) {_over(7)} END AS netrtg_std_l7_pre FROM bx),
mt AS (SELECT h.game_id, CASE WHEN h.game_id % 7 <> 0 THEN CAST(h.game_id % 21 - 10 AS DOUBLE) END AS line, CASE WHEN h.game_id % 5 <> 0 THEN CAST(120 + h.game_id % 60 AS DOUBLE) END AS total_line, CASE WHEN h.game_id % 3 = 0 THEN 130e0 ELSE -160e0 END AS ml_h,
  CASE WHEN h.game_id % 11 <> 0 THEN CASE WHEN h.game_id % 3 = 0 THEN -150e0 ELSE 140e0 END END AS ml_a, (({_d('h', 'pace', 70)}) + ({_d('a', 'pace', 70)})) / 2 AS pc, {_d('h', 'netrtg')} - {_d('a', 'netrtg')} AS net,
  CASE WHEN {_b('h', 'efg')} IS NULL OR {_b('a', 'efg')} IS NULL THEN 0 ELSE tanh((({_d('h', 'efg')} - {_d('a', 'efg')}) * 12 + ({_d('a', 'tov_pct')} - {_d('h', 'tov_pct')}) * 6 + ({_d('h', 'orb_pct')} - {_d('a', 'orb_pct')}) * 5 + ({_d('h', 'ftr')} - {_d('a', 'ftr')}) * 4) / 18) * 6 END AS ff,
  ({_d('h', 'ortg', 102)} + {_d('a', 'drtg', 102)}) / 2 + ({_d('a', 'ortg', 102)} + {_d('h', 'drtg', 102)}) / 2 AS per100, {_trust(0.8, 0.5)} AS sc, {_trust(0.9, 0.5)} AS tc, {_trust(0.9, 0.6)} AS mc
  FROM pk h JOIN pk a ON h.game_id = a.game_id WHERE h.home_away = 'home' AND a.home_away = 'away'),
md AS (SELECT *, (0.25e0 * net + 0.2e0 * ff) * pc / 100 + 2.7e0 AS m0, pc / 100 * per100 + 0.6e0 * ff AS t0 FROM mt),
an AS (SELECT *, CASE WHEN line IS NOT NULL AND sc < 0.8 THEN 0.9e0 * m0 + 0.1e0 * line ELSE m0 END AS m, CASE WHEN total_line IS NOT NULL AND tc < 0.82 THEN 0.9e0 * t0 + 0.1e0 * total_line ELSE t0 END AS t FROM md),
ed AS (SELECT *, m - line AS se, t - total_line AS te, 1 / (1 + exp(-m / 12)) AS p, CASE WHEN ml_a IS NOT NULL THEN 1 / (1 + exp(-m / 12)) - ({_implied('ml_h')}) END AS me FROM an)
SELECT game_id, {_r('m', 5)} AS model_margin_home, {_r('t', 5)} AS model_total, {_r('p', 5)} AS model_win_prob_home, {_r('se', 5)} AS spread_edge, {_r('sc', 5)} AS spread_conf, {_side('se', 3.0, 'home spread', 'away spread')} AS spread_side, coalesce({_units('se', 'sc', 3.0, 0.82)}, 0) AS spread_units,
{_r('te', 5)} AS total_edge, {_r('tc', 5)} AS total_conf, {_side('te', 3.5, 'Over', 'Under')} AS total_side, coalesce({_units('te', 'tc', 3.5, 0.84)}, 0) AS total_units, {_r('me', 5)} AS ml_edge, {_r('mc', 5)} AS ml_conf, {_side('me', 0.03, 'home ML', 'away ML')} AS ml_side,
CASE WHEN abs(me) >= 0.03 AND mc >= 0.84 THEN CASE WHEN CASE WHEN me >= 0.03 THEN ml_h ELSE ml_a END > 0 THEN CASE WHEN abs(me) >= 0.05 THEN 0.5e0 ELSE 0.25e0 END WHEN abs(me) >= 0.05 AND mc >= 0.87 THEN 2e0 ELSE 1e0 END ELSE 0e0 END AS ml_units FROM ed""")
def studio_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread, total and moneyline of every game from both sides' season and recent figures; lines are made of the game's number."""
    df = W.pack(P.eleven(team_games(spark, sf_dir), "game_id", "home_away"), [*P.NEEDED, "ortg", "drtg"], KEYS, ORDER)
    columns = [c for c in df.columns if c.endswith("_pre") and "_l3_" not in c]
    both = df.groupBy("game_id").agg(*[F.max(F.when(F.col("home_away") == s, F.struct(*columns))).alias(s) for s in ("home", "away")])
    g = F.col("game_id")
    row = both.select("game_id", *[F.col(f"{s}.{c}").alias(f"{s[0]}_{c}") for s in ("home", "away") for c in columns])
    line, total = F.when(g % 7 != 0, (g % 21 - 10).cast("double")), F.when(g % 5 != 0, (120 + g % 60).cast("double"))
    ml = F.when(g % 3 == 0, 130.0).otherwise(-160.0), F.when(g % 11 != 0, F.when(g % 3 == 0, -150.0).otherwise(140.0))
    out = P.markets(row, line, total, *ml)
    kinds = {k: R(c, 5) if not k.endswith(("_side", "_units")) else c for k, c in out.items()}
    return row.select("game_id", *[c.alias(k) for k, c in kinds.items()])


_DIFF = {"oreb_diff": "orb_pct", "dreb_diff": "drb_pct", "ftr_diff": "ftr", "efg_diff": "efg", "ts_diff": "ts_pct"}
_EDGE = {"efg": "efg", "ftr": "ftr", "orb": "orb_pct", "tov": "tov_pct"}


@query(f"""WITH {_ELEVEN}, op AS (SELECT a.*, {', '.join(f'b."{m}" AS "opp_{m}"' for m in P.ELEVEN)} FROM bx a JOIN bx b ON a.game_id = b.game_id AND a.home_away <> b.home_away),
al AS (SELECT *, {', '.join(f'avg({m}) {_over(7)} AS {k}_own, avg(opp_{m}) {_over(7)} AS {k}_allowed' for k, m in _EDGE.items())} FROM op)
SELECT a.game_id, a.home_away, {', '.join(f'{_r(f"a.{m} - a.opp_{m}")} AS {k}' for k, m in _DIFF.items())}, {_r('a.opp_tov_pct - a.tov_pct')} AS to_diff,
{', '.join(f'{_r(f"b.{k}_allowed - a.{k}_own" if k == "tov" else f"a.{k}_own - b.{k}_allowed")} AS {k}_edge_pre' for k in _EDGE)} FROM al a JOIN al b ON a.game_id = b.game_id AND a.home_away <> b.home_away""")
def matchup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's differences of figures, and the edges that both sides' earlier games let expect."""
    df = P.facing(P.eleven(team_games(spark, sf_dir), "game_id", "home_away").drop(*[f"opp_{c}" for c in _BOX]), "game_id", "home_away", list(P.ELEVEN))
    w = W.before(KEYS, ORDER, 7)
    df = df.withColumns({f"{k}_own": F.avg(m).over(w) for k, m in _EDGE.items()} | {f"{k}_allowed": F.avg(f"opp_{m}").over(w) for k, m in _EDGE.items()})
    df = P.facing(df, "game_id", "home_away", [f"{k}_allowed" for k in _EDGE])
    figures = (*_DIFF.values(), "tov_pct")
    out = M.differentials({m: F.col(m) for m in figures}, {m: F.col(f"opp_{m}") for m in figures}) | M.edges({k: F.col(f"{k}_own") for k in _EDGE}, {k: F.col(f"opp_{k}_allowed") for k in _EDGE})
    return df.select(*ID, *[R(c).alias(k) for k, c in out.items()])


_GRID = (3, 4, 5, 6, 7, 10, 12)


def _grid(m: str, n: int) -> str:
    over = f"OVER (PARTITION BY opp_team_id ORDER BY game_dt, game_id, home_away ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"{_r(f'CASE WHEN count({m}) {over} >= 3 THEN avg({m}) {over} END', 5)} AS {n}_pre_{m}_mean, {_r(f'min({m}) {over}', 5)} AS {n}_pre_{m}_min, {_r(f'max({m}) {over}', 5)} AS {n}_pre_{m}_max".replace(f"AS {n}_pre", f'AS "{n}_pre').replace("_mean,", '_mean",').replace("_min,", '_min",') + '"'


@query(f"""WITH {_ELEVEN}, op AS (SELECT a.game_id, a.home_away, a.game_dt, b.team_id AS opp_team_id, b.ortg AS opp_ortg, b.efg AS opp_efg FROM bx a JOIN bx b ON a.game_id = b.game_id AND a.home_away <> b.home_away)
SELECT game_id, home_away, {', '.join(_grid(m, n) for m in ('opp_ortg', 'opp_efg') for n in _GRID)} FROM op""")
def win_multi_grid_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of windows over the opponents' figures, by opponent."""
    df = P.facing(P.eleven(team_games(spark, sf_dir), "game_id", "home_away"), "game_id", "home_away", ["team_id", "ortg", "efg"])
    out = {}
    for m in ("opp_ortg", "opp_efg"):
        for n in _GRID:
            w = W.before(["opp_team_id"], ORDER, n)
            out |= {f"{n}_pre_{m}_mean": W.mean(F.col(m), w, 3), f"{n}_pre_{m}_min": F.min(m).over(w), f"{n}_pre_{m}_max": F.max(m).over(w)}
    return df.select(*ID, *[R(c, 5).alias(k) for k, c in out.items()])
