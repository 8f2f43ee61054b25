"""The card of a conference-tournament game: archetypes, upset chance, fragility, situation, and what they add up to. Parts are stated as in operators/rules.py."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipline.functions.columns import clip
from tipline.operators.quality import reasons
from tipline.operators.rules import Inputs

# Tiers of conferences, the least edge of a bet by tier, the weights of the edge, and what the Kelly share divides by.
TIERS = {"power6": ("acc", "big ten", "big 12", "sec", "big east", "pac-12"), "high_major_mid_major": ("a-10", "mwc", "wcc"), "true_mid_major": ("mvc", "caa", "mac")}
LEAST_EDGE = {"power6": 2.0, "high_major_mid_major": 1.5, "true_mid_major": 1.5, "low_major": 1.0}
EDGE_WEIGHTS = {"archetype_alignment_conf": 0.15, "dog_dna_score_conf": 0.13, "conf_fragility_index": 0.16, "situational_adjustment_points": 0.20, "third_meeting_adjustment": 0.12, "load_management_probability": 0.24}
KELLY_DIVISOR, LEAST_YEARS = 70.0, 5
# Largest stake and time of a bet by round.
ROUNDS = {"early": (0.5, "open_to_12hrs_before"), "semi": (0.75, "open_to_6hrs_before"), "final": (1.0, "open_to_4hrs_before")}


class Sign(NamedTuple):
    """A name that a team earns where an input reaches a value (above: exceeds it); share: the input is kept within 0 and 1."""

    name: str
    input: str
    least: float
    share: bool = True
    above: bool = False


# Signs of teams that do well and badly.
WINNING = (
    Sign("REVENGE_MACHINE", "revenge_score", 0.65), Sign("CONF_TOURNEY_SPECIALIST", "conf_tourney_coach_alpha", 0, share=False, above=True), Sign("MOTIVATION_CLARITY", "motivation_clarity_score", 8, share=False),
    Sign("SECOND_MEETING_ADJUSTER", "second_meeting_adjuster", 0.55), Sign("DEPTH_ADVANTAGE_FORMAT", "depth_vs_field_advantage", 1.0, share=False), Sign("NEUTRAL_SITE_ROAD_WARRIOR", "neutral_site_road_warrior", 0.6),
)
FAILING = (
    Sign("STAR_PRESERVATION_MODE", "load_management_risk_score", 0.55), Sign("FIRST_PLACE_HANGOVER", "first_place_hangover", 0.5), Sign("FAMILIARITY_EXPLOITED", "familiarity_exploited", 0.5),
    Sign("BUBBLE_PARALYSIS", "bubble_paralysis", 0.5), Sign("TRANSFER_PORTAL_CHAOS", "first_year_transfers", 4, share=False), Sign("CONFERENCE_TOURNEY_EXHAUSTED", "conf_tourney_exhausted", 0.5),
)


def _share(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def tier(conference: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(conference, F.lit(""))))
    return reduce(lambda out, t: F.when(key.isin(*TIERS[t]), t).otherwise(out), TIERS, F.lit("low_major"))


def signs(x: Inputs, side: str, group: tuple[Sign, ...]) -> Column:
    def earned(s: Sign) -> Column:
        default = 5.0 if s.input == "motivation_clarity_score" else None
        v = x(f"{side}.{s.input}", default)
        v = _share(v) if s.share else v
        return v > s.least if s.above else v >= s.least

    return reasons({s.name: earned(s) for s in group})


def rounds_survived(x: Inputs, side: str) -> Column:
    """Chances to survive no round, one, two, and more."""
    depth, coach, warrior = x(f"{side}.depth_vs_field_advantage"), x(f"{side}.conf_tourney_coach_alpha"), _share(x(f"{side}.neutral_site_road_warrior"))
    motivation, load = clip(F.floor(x(f"{side}.motivation_clarity_score", 5.0)).cast("double"), 1.0, 10.0), _share(x(f"{side}.load_management_risk_score"))
    found = {"0": 0.35 - depth * 0.03 + load * 0.15, "1": 0.3 + motivation * 0.02, "2": 0.22 + coach * 0.05, "3_plus": 0.12 + F.greatest(depth, F.lit(0.0)) * 0.04 + warrior * 0.08}
    return F.struct(*[F.round(_share(c), 3).alias(k) for k, c in found.items()])


def card(df: DataFrame, team_a: str = "a_", team_b: str = "b_", game: str = "", names: dict[str, str] | None = None) -> dict[str, Column]:
    """Columns of the card. team_a is the favourite whose fragility counts, team_b the side whose situation does; missing inputs take their defaults."""
    x = Inputs(df, {"a": team_a, "b": team_b, "g": game}, names)

    def text(name: str, default: str) -> Column:
        c = x.raw(name)
        return F.lit(default) if c is None else F.coalesce(c.cast("string"), F.lit(default))

    # The chance of an upset.
    dog, third, tired = _share(x("g.dog_dna_score_conf", 0.5)), x("g.third_meeting_adjustment"), x("g.fatigue_differential")
    on = lambda n: x(f"g.{n}") != 0
    drivers = {"third_meeting_motivation_asymmetry": third > 0, "fatigue_differential": tired > 0, "PRESS_BREAK_OR_DIE": on("press_break_mismatch"), "PACE_HIJACK": on("pace_hijack_signal"), "ZONE_SURPRISE_VALUE": on("zone_surprise_signal")}
    # What the favourite may break at.
    risk = x.raw("a.load_management_risk")
    load = _share(x("a.load_management_probability") if risk is None else F.coalesce(risk.cast("double"), x("a.load_management_probability")))
    wall, key_player, bracket = _share(x("a.game_3_fatigue_wall_score")), _share(x("a.key_player_dependency_score")), _share(x("a.bracket_motivation_score", 0.5))
    fragility = _share(0.45 * load + 0.25 * wall + 0.2 * key_player + 0.1 * (1 - bracket))
    breaks = {"LOAD_MANAGEMENT_EXPOSURE": load >= 0.5, "THIRD_GAME_IN_FOUR_DAYS_WALL": wall >= 0.5, "KEY_PLAYER_DEPENDENCY": key_player >= 0.5, "BRACKET_KNOWLEDGE_TRAP": bracket <= 0.4}
    # The edge: nothing without years of checked lines.
    situation = x("b.situational_adjustment_points")
    parts = {"archetype_alignment_conf": x("g.archetype_alignment_conf"), "dog_dna_score_conf": dog, "conf_fragility_index": fragility, "situational_adjustment_points": situation, "third_meeting_adjustment": third, "load_management_probability": load}
    model = reduce(lambda a, b: a + b, [parts[k] * w for k, w in EDGE_WEIGHTS.items()]) / sum(EDGE_WEIGHTS.values())
    edge = F.when(x("g.clv_validation_years", float(LEAST_YEARS)) >= LEAST_YEARS, model - x("g.market_implied_edge")).otherwise(0.0)
    conference = tier(text("g.conference", ""))
    least = reduce(lambda out, t: F.when(conference == t, LEAST_EDGE[t]).otherwise(out), LEAST_EDGE, F.lit(LEAST_EDGE["low_major"]))
    line = x("g.market_spread")
    signed = lambda v: F.format_string("%s%s", F.when(v < 0, "-").otherwise("+"), F.regexp_replace(F.abs(v).cast("string"), r"\.0$", ""))
    bet = F.when(edge >= least, F.concat_ws(" ", text("b.team", "Team B"), signed(-line))).when(edge <= -least, F.concat_ws(" ", text("a.team", "Team A"), signed(line))).otherwise(text("g.default_recommended_bet", "pass"))
    name = F.lower(text("g.tournament_round", ""))
    late = F.when(name.contains("semi"), "semi").when(name.contains("final"), "final").otherwise("early")
    by_round = lambda k: reduce(lambda out, r: F.when(late == r, ROUNDS[r][k]).otherwise(out), ROUNDS, F.lit(ROUNDS["early"][k]))
    first = lambda side: F.coalesce(F.get(signs(x, side, WINNING), F.lit(0)), F.lit("NONE"))
    return {
        "archetype_a": first("a"), "archetype_b": first("b"), "failing_a": signs(x, "a", FAILING), "failing_b": signs(x, "b", FAILING), "survives_a": rounds_survived(x, "a"), "survives_b": rounds_survived(x, "b"),
        "dog_dna_score": dog, "upset_prob": _share(0.25 + 0.35 * dog + 0.08 * third + 0.04 * tired), "upset_archetype": F.when(tired > third, "FATIGUE_BASED_UPSET").otherwise("THIRD_MEETING_EDGE"), "key_upset_drivers": reasons(drivers),
        "fragility_index": fragility, "load_mgmt_prob": load, "bracket_motivation": F.when(bracket < 0.5, "low").otherwise("high"), "fragility_drivers": reasons(breaks), "fade": F.when(fragility >= 0.55, "fade_favorite").otherwise("no_fade"),
        "situational_adjustment": situation, "edge": edge, "composite_edge": F.round(edge, 3), "recommended_bet": bet, "kelly_recommended": F.round(F.greatest(F.lit(0.0), edge / KELLY_DIVISOR), 4),
        "confidence_tier": F.when(edge >= least + 1, "A").when(edge >= least, "B").otherwise("C"), "timing": F.concat(F.lit("bet now — "), by_round(1)), "max_bet_units": by_round(0),
        "live_bet_watch": F.when((fragility >= 0.45) | (key_player >= 0.55), "star foul trouble trigger active").otherwise("none"), "conference_tier_adjustment": conference,
    }
