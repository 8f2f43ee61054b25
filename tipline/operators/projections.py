"""Projections of games from what both sides did before: an expectation model in two steps, and blended market projections."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipline.functions import basketball as B
from tipline.functions.betting import implied
from tipline.functions.columns import clip, safe_div
from tipline.operators.windows import before

BOX = ("fgm", "fga", "tpm", "fta", "orb", "drb", "tov", "points")


def facing(df: DataFrame, event: str, side: str, columns: list[str]) -> DataFrame:
    """Rows of events with both sides, each with the given columns of the other side as opp_ columns. One aggregation, no self-join."""
    sides = [F.max(F.when(F.col(side) == s, F.struct("*"))).alias(s) for s in ("home", "away")]
    both = df.groupBy(event).agg(*sides).where("home IS NOT NULL AND away IS NOT NULL")
    pairs = F.array(F.struct(F.col("home").alias("own"), F.col("away").alias("other")), F.struct(F.col("away").alias("own"), F.col("home").alias("other")))
    return both.select(F.inline(pairs)).select("own.*", *[F.col(f"other.{c}").alias(f"opp_{c}") for c in columns])


# What counts for a team or opponent without earlier games, weights and scales of the expectation model.
FIRST_GAME = {"efg": 0.50, "orb_pct": 0.30, "ftr": 0.30, "off_eff": 105.0, "tov_pct": 15.0, "drb_pct": 0.70, "own_off": 105.0, "own_def": 105.0, "margin": 0.0, "total": 144.0}
UNKNOWN_TEAM = {"team_off_eff": 105.0, "team_net_eff": 0.0, "team_pace": 70.0, "team_efg": 0.50, "team_tov_pct": 15.0, "team_orb_pct": 0.30, "team_drb_pct": 0.70, "team_ftr": 0.30}
FACTOR_WEIGHTS = {"efg": 0.28, "tov": 0.22, "orb": 0.18, "drb": 0.16, "ftr": 0.16}
RECENT, LONGER, RAW, VERSUS, SCHEDULE, USUAL_PACE, HOME = 0.70, 0.30, 0.30, 0.70, 0.35, 70.0, 3.2


def _positive(a: Column, b: Column, default: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def played(df: DataFrame, event: str, side: str) -> DataFrame:
    """Both sides' rates of each game, from the box score."""
    df = facing(df, event, side, list(BOX))
    for p, q in (("", "opp_"), ("opp_", "")):
        c = {n: F.col(p + n) for n in BOX}
        poss = B.possessions_oliver(c["fga"], c["fta"], c["orb"], c["tov"], F.col(f"{q}orb"))
        df = df.withColumn(f"{p}pos", poss).withColumns({
            f"{p}r_efg": _positive(c["fgm"] + 0.5 * c["tpm"], c["fga"], 0.5), f"{p}r_tov": _positive(c["tov"], F.col(f"{p}pos"), 0.15) * 100, f"{p}r_orb": _positive(c["orb"], c["orb"] + F.col(f"{q}drb"), 0.30),
            f"{p}r_drb": _positive(c["drb"], c["drb"] + F.col(f"{q}orb"), 0.70), f"{p}r_ftr": _positive(c["fta"], c["fga"], 0.30), f"{p}r_eff": _positive(c["points"] * 100, F.col(f"{p}pos"), 100.0),
        })
    return df


def expectations(df: DataFrame, event: str, side: str, team: list[str], order: list[str], window: int = 5) -> DataFrame:
    """Each game's figures against what the opponent let others do in its games before: raw (team_) and relative (_vs_exp) columns."""
    games = played(df, event, side)
    w = before(team, order, window)
    # What a team allowed and forced is what its opponents did against it.
    allowed = {"efg": "opp_r_efg", "orb_pct": "opp_r_orb", "ftr": "opp_r_ftr", "off_eff": "opp_r_eff", "tov_pct": "opp_r_tov", "drb_pct": "r_drb", "own_off": "r_eff", "own_def": "opp_r_eff"}
    usual = {k: F.avg(c).over(w) for k, c in allowed.items()} | {"margin": F.avg(F.col("opp_points") - F.col("points")).over(w), "total": F.avg(F.col("opp_points") + F.col("points")).over(w)}
    games = games.withColumns({f"base_{k}": F.coalesce(c, F.lit(FIRST_GAME[k])) for k, c in usual.items()})
    met = facing(games, event, side, [f"base_{k}" for k in usual])
    b = lambda k: F.col(f"opp_base_{k}")
    own_def = _positive(F.col("opp_points") * 100, F.col("pos"), 100.0)
    return met.withColumns({
        "team_off_eff": F.col("r_eff"), "team_net_eff": F.col("r_eff") - own_def, "team_pace": F.col("pos"), "team_efg": F.col("r_efg"), "team_tov_pct": F.col("r_tov"), "team_orb_pct": F.col("r_orb"),
        "team_drb_pct": F.col("r_drb"), "team_ftr": F.col("r_ftr"), "efg_vs_exp": (F.col("r_efg") - b("efg")) * 100, "orb_vs_exp": (F.col("r_orb") - b("orb_pct")) * 100, "ftr_vs_exp": (F.col("r_ftr") - b("ftr")) * 100,
        "tov_vs_exp": b("tov_pct") - F.col("r_tov"), "drb_vs_exp": (F.col("r_drb") - (1 - b("drb_pct"))) * 100, "off_eff_vs_exp": F.col("r_eff") - b("off_eff"), "margin_vs_exp": F.col("points") - F.col("opp_points") - b("margin"),
        "total_vs_exp": F.col("points") + F.col("opp_points") - b("total"), "opp_quality": b("own_off") - b("own_def"),
    })


def expected_spreads(df: DataFrame, event: str, side: str, team: list[str], order: list[str], recent: int = 5, longer: int = 10, neutral: Column | None = None) -> DataFrame:
    """One row per game: predicted_spread (negative: the home side is favoured), confidence, pace and the parts of the edge, all from earlier games.

    Two steps back: a team's earlier games are measured against what their opponents allowed in the games before those. Each step is a window by team; sides meet
    in aggregations by game."""
    games = expectations(df, event, side, team, order)
    figures = [*UNKNOWN_TEAM, *(f"{k}_vs_exp" for k in ("efg", "orb", "ftr", "tov", "drb", "off_eff")), "opp_quality"]
    spans = {"_near": before(team, order, recent), "_far": before(team, order, longer)}
    means = {f"{k}{s}": F.coalesce(F.avg(k).over(w), F.lit(UNKNOWN_TEAM.get(k, 0.0))) for s, w in spans.items() for k in figures}
    games = games.withColumns(means | {"_n": F.count("r_eff").over(spans["_near"])})
    blend = {k: RECENT * F.col(f"{k}_near") + LONGER * F.col(f"{k}_far") for k in figures}
    steady = F.greatest(F.lit(0.0), 1 - F.abs(F.col("team_net_eff_near") - F.col("team_net_eff_far")) / 20)
    sides = games.select(event, side, *[c.alias(k) for k, c in blend.items()], F.least(F.col("_n") / recent, F.lit(1.0)).alias("sample"), steady.alias("steady"))
    both = sides.groupBy(event).agg(*[F.max(F.when(F.col(side) == s, F.struct(*figures, "sample", "steady"))).alias(s) for s in ("home", "away")])
    gap = lambda k: F.col(f"home.{k}") - F.col(f"away.{k}")
    raw = {"efg": gap("team_efg") * 100, "tov": -gap("team_tov_pct"), "orb": gap("team_orb_pct") * 100, "drb": gap("team_drb_pct") * 100, "ftr": gap("team_ftr") * 100}
    composite = reduce(lambda a, b: a + b, [w * (RAW * raw[k] + VERSUS * gap(f"{k}_vs_exp")) for k, w in FACTOR_WEIGHTS.items()])
    efficiency = RAW * gap("team_net_eff") + VERSUS * gap("off_eff_vs_exp")
    pace = (F.col("home.team_pace") + F.col("away.team_pace")) / 2
    schedule = gap("opp_quality") * SCHEDULE
    home = F.lit(HOME) if neutral is None else F.when(neutral, 0.0).otherwise(HOME)
    trust = 0.6 * (F.col("home.sample") + F.col("away.sample")) / 2 + 0.4 * (F.col("home.steady") + F.col("away.steady")) / 2
    edge = (0.60 * efficiency + 0.40 * composite) * pace / USUAL_PACE + schedule
    return both.select(event, (-(edge + home)).alias("predicted_spread"), F.least(F.lit(0.95), trust).alias("confidence"), pace.alias("pace"), efficiency.alias("eff_edge"), composite.alias("composite_edge"), schedule.alias("sos_factor"))


class Market(NamedTuple):
    """Settings of one market: window and share of the recent figures, how far schedule and swings move the confidence, and how the market's line anchors."""

    window: int = 7
    recent: float = 0.35
    schedule: float = 0.5
    swings: float = 0.8
    anchor: float = 0.10
    anchor_below: float = 0.80


class Strategy(NamedTuple):
    """Least edge and confidence of a bet, and what a second and third unit need beyond."""

    edge: float
    confidence: float
    more_edge: tuple[float, float] = (1.5, 3.0)
    more_confidence: tuple[float, float] = (0.03, 0.05)


# The markets' settings, the weights of a margin's parts, and points for a difference in each of the four factors.
SPREAD, TOTAL, MONEYLINE = Market(), Market(swings=0.9, anchor_below=0.82), Market(schedule=0.6, swings=0.9, anchor_below=0.84)
SPREAD_BETS, TOTAL_BETS, MONEYLINE_BETS = Strategy(3.0, 0.82), Strategy(3.5, 0.84), Strategy(0.03, 0.84)
MARGIN_PARTS = {"rating": 0.55, "net": 0.25, "factors": 0.20}
FACTOR_POINTS = {"efg": 12.0, "tov_pct": -6.0, "orb_pct": 5.0, "ftr": 4.0}
HOME_COURT, WIN_SCALE = 2.7, 12.0
NEEDED = ("netrtg", "pace", "efg", "tov_pct", "orb_pct", "ftr")


class Meeting:
    """Two sides' latest figures in one row: metric_season_pre, metric_lN_pre and metric_std_lN_pre under each side's prefix, adjem and sos if there are."""

    def __init__(self, df: DataFrame, market: Market, home: str, away: str):
        self.columns, self.market, self.sides = set(df.columns), market, (home, away)

    def own(self, side: str, name: str) -> Column:
        return F.col(side + name).cast("double") if side + name in self.columns else F.lit(None).cast("double")

    def blended(self, side: str, metric: str) -> Column:
        """Season and recent figure by the recent share; the other one where one is missing."""
        season, recent = self.own(side, f"{metric}_season_pre"), self.own(side, f"{metric}_l{self.market.window}_pre")
        return F.coalesce((1 - self.market.recent) * season + self.market.recent * recent, season, recent)

    def both(self, metric: str, default: float = 0.0) -> tuple[Column, Column]:
        a, b = (F.coalesce(self.blended(s, metric), F.lit(default)) for s in self.sides)
        return a, b

    def pace(self) -> Column:
        a, b = self.both("pace", 70.0)
        return (a + b) / 2

    def factors(self) -> Column:
        """Bounded points from the four factors; 0 without both sides' shooting."""
        known = self.blended(self.sides[0], "efg").isNotNull() & self.blended(self.sides[1], "efg").isNotNull()
        raw = reduce(lambda a, b: a + b, [(x - y) * points for k, points in FACTOR_POINTS.items() for x, y in [self.both(k)]])
        return F.when(known, F.tanh(raw / 18) * 6).otherwise(0.0)

    def reliability(self) -> Column:
        m = self.market
        lacking = sum((F.when(self.blended(self.sides[0], k).isNull() & self.blended(self.sides[1], k).isNull(), 1).otherwise(0) for k in NEEDED), F.lit(0))
        a, b = (F.coalesce(self.own(s, f"netrtg_std_l{m.window}_pre"), F.lit(0.0)) for s in self.sides)
        x, y = (F.coalesce(self.own(s, "sos"), F.lit(0.0)) for s in self.sides)
        trust = 0.88 - 0.05 * lacking / len(NEEDED) - m.swings * clip((a + b) / 2 / 10, 0.0, 0.10) + clip((x - y) / 200, -0.03, 0.03) * m.schedule
        return clip(trust, 0.70, 0.97)


def _anchored(model: Column, line: Column, trust: Column, m: Market) -> Column:
    return F.when(line.isNotNull() & (trust < m.anchor_below), (1 - m.anchor) * model + m.anchor * line).otherwise(model)


def _bet(edge: Column, trust: Column, s: Strategy, over: str, under: str) -> tuple[Column, Column]:
    """Side and units; more units by larger edges that are also surer."""
    side = F.when(edge >= s.edge, over).when(edge <= -s.edge, under)
    more = [(F.abs(edge) >= s.edge + e) & (trust >= s.confidence + c) for e, c in zip(s.more_edge, s.more_confidence, strict=True)]
    return side, F.when(side.isNotNull() & (trust >= s.confidence), F.when(more[1], 3.0).when(more[0], 2.0).otherwise(1.0)).otherwise(0.0)


def markets(df: DataFrame, spread: Column, total: Column, ml_home: Column, ml_away: Column, home: str = "h_", away: str = "a_") -> dict[str, Column]:
    """Margin, total and chance of the home side with edges against the market's lines, confidence, side and units. Missing lines give no edge and no bet."""
    sp, to, ml = (Meeting(df, m, home, away) for m in (SPREAD, TOTAL, MONEYLINE))
    rating = F.coalesce(sp.own(home, "adjem"), F.lit(0.0)) - F.coalesce(sp.own(away, "adjem"), F.lit(0.0))
    net = sp.both("netrtg")
    parts = MARGIN_PARTS["rating"] * rating + MARGIN_PARTS["net"] * (net[0] - net[1]) + MARGIN_PARTS["factors"] * sp.factors()
    sp_conf, to_conf, ml_conf = (m.reliability() for m in (sp, to, ml))
    margin = _anchored(parts * sp.pace() / 100 + HOME_COURT, spread, sp_conf, SPREAD)
    (off_h, off_a), (def_h, def_a) = to.both("ortg", 102.0), to.both("drtg", 102.0)
    points = _anchored(to.pace() / 100 * ((off_h + def_a) / 2 + (off_a + def_h) / 2) + 0.6 * to.factors(), total, to_conf, TOTAL)
    chance = 1 / (1 + F.exp(-margin / WIN_SCALE))
    edges = {"spread": margin - spread, "total": points - total, "ml": F.when(implied(ml_away).isNotNull(), chance - implied(ml_home))}
    sides = {"spread": _bet(edges["spread"], sp_conf, SPREAD_BETS, "home spread", "away spread"), "total": _bet(edges["total"], to_conf, TOTAL_BETS, "Over", "Under")}
    s, edge = MONEYLINE_BETS, edges["ml"]
    side = F.when(edge >= s.edge, "home ML").when(edge <= -s.edge, "away ML")
    # Little on an outsider, more on a sure favourite.
    price = F.when(edge >= s.edge, ml_home).otherwise(ml_away)
    far = F.abs(edge) >= s.edge + 0.02
    units = F.when(price > 0, F.when(far, 0.5).otherwise(0.25)).when(far & (ml_conf >= s.confidence + 0.03), 2.0).otherwise(1.0)
    sides["ml"] = side, F.when(side.isNotNull() & (ml_conf >= s.confidence), units).otherwise(0.0)
    out = {"model_margin_home": margin, "model_total": points, "model_win_prob_home": chance}
    for k, conf in (("spread", sp_conf), ("total", to_conf), ("ml", ml_conf)):
        out |= {f"{k}_edge": edges[k], f"{k}_conf": conf, f"{k}_side": sides[k][0], f"{k}_units": sides[k][1]}
    return out


def eleven(df: DataFrame, event: str, side: str) -> DataFrame:
    """The core metrics of a team's game: ratings, pace, the four factors and shooting shares; pace is the mean of both sides' possessions."""
    df = facing(df, event, side, [*BOX, "tpa"])
    c = lambda n: F.col(n)
    own, opp = B.possessions(c("fga"), c("fta"), c("orb"), c("tov")), B.possessions(c("opp_fga"), c("opp_fta"), c("opp_orb"), c("opp_tov"))
    pace = (own + opp) / 2
    ortg, drtg = B.per_100(c("points"), pace), B.per_100(c("opp_points"), pace)
    return df.withColumns({
        "ortg": ortg, "drtg": drtg, "netrtg": ortg - drtg, "pace": pace, "efg": safe_div(c("fgm") + 0.5 * c("tpm"), c("fga")), "tov_pct": safe_div(100 * c("tov"), own), "orb_pct": safe_div(c("orb"), c("orb") + c("opp_drb")),
        "drb_pct": safe_div(c("drb"), c("drb") + c("opp_orb")), "ftr": safe_div(c("fta"), c("fga")), "3par": safe_div(c("tpa"), c("fga")), "ts_pct": B.true_shooting(c("points"), c("fga"), c("fta")),
    })


ELEVEN = ("ortg", "drtg", "netrtg", "pace", "efg", "tov_pct", "orb_pct", "drb_pct", "ftr", "3par", "ts_pct")
