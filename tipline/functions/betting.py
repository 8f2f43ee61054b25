"""Odds, edges and stakes as columns. A missing or impossible price gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipline.functions.columns import clip, safe_div


def implied(odds: Column) -> Column:
    """Probability that American odds imply."""
    return F.when(odds > 0, 100 / (odds + 100.0)).when(odds < 0, -odds / (-odds + 100.0))


def implied_or(odds: Column, otherwise: str) -> Column:
    """implied(), with 0 for a missing or impossible price (otherwise="zero"), null ("null"), or an error ("raise")."""
    p = implied(odds)
    if otherwise == "raise":
        return F.coalesce(p, F.raise_error(F.concat(F.lit("no American odds: "), F.coalesce(odds.cast("string"), F.lit("null")))).cast("double"))
    if otherwise not in ("zero", "null"):
        raise ValueError(otherwise)
    return F.coalesce(p, F.lit(0.0)) if otherwise == "zero" else p


def sharpe(df: DataFrame, profit: str) -> DataFrame:
    """One row: mean profit of a bet over its deviation (population), times the root of the number of bets; 0 without spread."""
    n, mean, spread = F.count(profit), F.avg(profit), F.stddev_pop(profit)
    return df.agg(F.when(spread > 0, mean / spread * F.sqrt(n)).otherwise(0.0).alias("sharpe"), n.alias("n"))


def american(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), None).when(p >= 0.5, -100 * p / (1 - p)).otherwise(100 * (1 - p) / p)


def without_vig(a: Column, b: Column) -> tuple[Column, Column]:
    return safe_div(a, a + b), safe_div(b, a + b)


def payout(odds: Column) -> Column:
    """Profit of one unit staked, if it wins."""
    return F.when(odds > 0, odds / 100.0).when(odds < 0, 100.0 / -odds)


def expected_value(p: Column, odds: Column, stake: float = 1.0) -> Column:
    return stake * (p * payout(odds) - (1 - p))


def kelly(p: Column, odds: Column) -> Column:
    """Share of the bankroll; never below 0."""
    b = payout(odds)
    return F.when(b > 0, F.greatest(F.lit(0.0), (b * p - (1 - p)) / b))


def units(fraction: Column, part: float = 0.25, scale: float = 3.0, most: float = 3.0) -> Column:
    return F.when(fraction.isNotNull(), F.least(fraction * part * scale, F.lit(most)))


def passes(edge: Column, confidence: Column, least_edge: float = 0.02, least_confidence: float = 0.7) -> Column:
    return F.coalesce((edge >= least_edge) & (confidence >= least_confidence), F.lit(False))


def spread_bet(predicted: Column, line: Column, least: float = 2.0) -> dict[str, Column]:
    """Home, away or no bet by the points between prediction and line; win probability, value at -110 and Kelly share."""
    edge = predicted + line
    p = clip(0.5 + F.abs(edge) / 10 / 2, 0.05, 0.95)
    side = F.when(edge >= least, "home").when(edge <= -least, "away").otherwise("none")
    return {"edge": edge, "bet": side, "win_prob": p, "ev": p * 0.91 - (1 - p), "kelly": F.greatest(F.lit(0.0), (0.91 * p - (1 - p)) / 0.91)}


def edge_tier(edge: Column, confidence: Column) -> Column:
    e = F.abs(edge)
    return F.when((e >= 6) & (confidence >= 0.75), "A").when((e >= 4) & (confidence >= 0.65), "B").when((e >= 2.5) & (confidence >= 0.55), "C").otherwise("none")


def confidence(edge: Column) -> Column:
    return 1 - F.exp(-F.abs(edge) / 6)


def ats_result(margin: Column, line: Column, bet: Column) -> Column:
    """1 won, 0 lost, 0.5 push, null without a bet or a result."""
    home = F.when(margin + line > 0, 1.0).when(margin + line < 0, 0.0).otherwise(0.5)
    return F.when(margin.isNull() | line.isNull(), None).when(bet == "home", home).when(bet == "away", 1 - home)


def profit(result: Column, price: float = 100 / 110) -> Column:
    """Units won at -110."""
    return F.when(result == 1, price).when(result == 0, -1.0).when(result == 0.5, 0.0)


def logistic(x: Column, scale: float = 1.0) -> Column:
    """Without overflow for any x."""
    z = x / scale
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def bounded(x: Column, most: float) -> Column:
    return most * F.tanh(x / most)


def value_units(edge: Column, confidence: Column, least_edge: float = 2.0, least_confidence: float = 0.6, edges: tuple[float, float] = (1.5, 3.0), confidences: tuple[float, float] = (0.05, 0.10)) -> Column:
    """No unit below the edge or confidence asked for, else one, or two or three where both are higher by the bonuses."""
    e = F.abs(edge)
    second, third = ((e >= least_edge + a) & (confidence >= least_confidence + b) for a, b in zip(edges, confidences, strict=True))
    return F.when((e < least_edge) | (confidence < least_confidence) | e.isNull() | confidence.isNull(), 0.0).when(third, 3.0).when(second, 2.0).otherwise(1.0)


def moneyline_units(edge: Column, confidence: Column, price: Column, least_edge: float = 0.03, least_confidence: float = 0.6) -> Column:
    """Underdogs get a quarter or half a unit, favourites one or two."""
    e = F.abs(edge)
    dog = F.when(e < least_edge + 0.02, 0.25).otherwise(0.5)
    favourite = F.when((e >= least_edge + 0.02) & (confidence >= least_confidence + 0.03), 2.0).otherwise(1.0)
    return F.when((e < least_edge) | (confidence < least_confidence) | e.isNull(), 0.0).when(price > 0, dog).otherwise(favourite)


def total_edge(predicted: Column, market: Column) -> dict[str, Column]:
    edge = predicted - market
    return {"total_edge": edge, "total_rec": F.when(edge > 0, "BET_OVER").when(edge < 0, "BET_UNDER").otherwise("PASS")}


def moneyline_edge(p_home: Column, home: Column, away: Column, stake: float = 100.0) -> dict[str, Column]:
    """Edge over the implied probability, value of both bets, and the better one. A home bet needs more value than the away bet; an away bet more than none."""
    a, b = expected_value(p_home, home, stake), expected_value(1 - p_home, away, stake)
    return {"ml_edge": p_home - implied(home), "home_ml_ev": a, "away_ml_ev": b, "ml_rec": F.when(a > b, "BET_HOME_ML").when(b > 0, "BET_AWAY_ML").otherwise("PASS")}
