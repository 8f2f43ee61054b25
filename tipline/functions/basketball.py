"""Box-score and efficiency formulas as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipline.functions.columns import clip, safe_div


def possessions(fga: Column, fta: Column, orb: Column, tov: Column) -> Column:
    return fga + 0.44 * fta - orb + tov


def possessions_oliver(fga: Column, fta: Column, orb: Column, tov: Column, opp_orb: Column) -> Column:
    return fga + 0.475 * fta - orb + tov + 0.33 * opp_orb


def four_factors(fgm: Column, fga: Column, tpm: Column, tov: Column, fta: Column, orb: Column, opp_drb: Column, poss: Column) -> dict[str, Column]:
    """Effective field goals, turnovers per 100, offensive rebounds and free-throw rate, with their usual values where a base is 0."""
    return {
        "efg": safe_div(fgm + 0.5 * tpm, fga, 0.5),
        "tov_pct": safe_div(100 * tov, poss, 15.0),
        "orb_pct": safe_div(orb, orb + opp_drb, 0.30),
        "ftr": safe_div(fta, fga, 0.70),
    }


def true_shooting(points: Column, fga: Column, fta: Column) -> Column:
    return safe_div(points, 2 * (fga + 0.44 * fta))


def per_100(amount: Column, poss: Column) -> Column:
    return safe_div(100 * amount, poss)


def flags(margin: Column, pace: Column) -> dict[str, Column]:
    """Blowout (18 points or more), extreme pace, and either of them; a missing pace is not extreme."""
    blowout = F.coalesce(F.abs(margin) >= 18, F.lit(False))
    extreme = F.coalesce((pace >= 85) | (pace <= 55), F.lit(False))
    return {"is_blowout": blowout.cast("long"), "is_extreme_pace": extreme.cast("long"), "is_noise": (blowout | extreme).cast("long")}


def overtimes(status: Column) -> Column:
    """Number of overtimes that a status text names: 0 if none."""
    many = F.regexp_extract(status, r"/(\d+)OT", 1)
    return F.when(many != "", many.cast("long")).when(status.rlike(r"\bOT\b|/OT|OT$"), 1).otherwise(0).cast("long")


def expected(ortg: Column, drtg: Column, pace: Column, opp_ortg: Column, opp_drtg: Column, opp_pace: Column) -> dict[str, Column]:
    """What two teams' earlier games let expect of this one: each side's attack against the other's defence, at their mean pace."""
    exp_ortg, exp_drtg, exp_pace = (ortg + opp_drtg) / 2, (drtg + opp_ortg) / 2, (pace + opp_pace) / 2
    return {"exp_ortg": exp_ortg, "exp_drtg": exp_drtg, "exp_pace": exp_pace, "exp_net": exp_ortg - exp_drtg, "exp_margin": (exp_ortg - exp_drtg) * exp_pace / 100}


def style_distance(own: list[Column], other: list[Column]) -> Column:
    """Euclidean; a missing difference counts as none."""
    zero = F.lit(0.0)
    return F.sqrt(reduce(lambda a, b: a + b, [F.coalesce((x - y) * (x - y), zero) for x, y in zip(own, other, strict=True)]))


def opponent_weight(z: Column) -> Column:
    return clip(1 + 0.15 * z, 0.85, 1.25)


def relevance(z: list[Column], target: list[float], tau: float) -> Column:
    return F.exp(-reduce(lambda a, b: a + b, [F.abs(x - F.lit(t)) for x, t in zip(z, target, strict=True)]) / tau)


def game_quality(tournament: Column, conference: Column, opponent_net: Column, neutral: Column) -> Column:
    """50, with 40 for tournament games, 10 for conference games, the opponent's net rating and 5 for neutral courts; 10 to 100."""
    score = 50 + F.when(tournament, 40).otherwise(0) + F.when(conference, 10).otherwise(0) + F.coalesce(opponent_net, F.lit(0.0)) + F.when(neutral, 5).otherwise(0)
    return clip(score, 10.0, 100.0)
