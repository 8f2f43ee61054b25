"""Queries over rule cards: tournament scores, tags and projections from two sides' figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.functions import betting as O
from tipline.functions import columns as C
from tipline.operators import conference as CF
from tipline.operators import rules as U
from tipline.plans.adapter import GAMES, games
from tipline.plans.registry import query

R = C.rounded

# Inputs of the cards, made of a game's number; the same text serves Spark and DuckDB.
_SIDES = {
    "dog_off_eff_rank": "CAST(game_id * 7 % 340 AS DOUBLE)", "dog_def_eff_rank": "CAST(game_id * 13 % 300 AS DOUBLE)", "fav_pace_rank": "CAST(game_id * 11 % 350 AS DOUBLE)",
    "dog_pace_rank": "CASE WHEN game_id % 5 = 0 THEN NULL ELSE CAST(game_id * 3 % 350 AS DOUBLE) END", "dog_ft_rate": "game_id % 40 / 100e0", "fav_opp_ft_rate_allowed": "game_id % 25 / 100e0",
    "dog_three_pt_def_rank": "CAST(game_id % 60 AS DOUBLE)", "fav_three_pt_off_rank": "CAST(game_id % 45 AS DOUBLE)", "dog_off_reb_rate": "game_id % 37 / 100e0", "fav_def_reb_rate": "game_id % 31 / 100e0",
    "dog_steal_rate_rank": "CAST(game_id % 90 AS DOUBLE)", "dog_forced_to_rate_rank": "CAST(game_id % 77 AS DOUBLE)", "dog_players_10plus_tourney_minutes_positive_pm": "CAST(game_id % 6 AS DOUBLE)", "dog_high_volume_38pct_3pt_shooters": "CAST(game_id % 4 AS DOUBLE)",
    "dog_coach_dog_ats_score": "game_id % 83 / 100e0", "dog_seed": "CAST(9 + game_id % 8 AS DOUBLE)", "dog_kenpom_equivalent_seed": "CAST(6 + game_id % 9 AS DOUBLE)", "fav_seed": "CAST(1 + game_id % 7 AS DOUBLE)",
    "dog_auto_bid": "CAST(game_id % 2 AS DOUBLE)", "fav_power_program_flag": "CAST(game_id % 3 % 2 AS DOUBLE)", "fav_point_diff_rank": "CAST(game_id * 5 % 200 AS DOUBLE)", "fav_kenpom_eff_rank": "CAST(game_id * 3 % 120 AS DOUBLE)",
    "fav_turnover_rate_rank": "CAST(game_id % 220 AS DOUBLE)", "fav_three_pt_def_rank": "CAST(game_id % 170 AS DOUBLE)", "dog_three_pt_attempt_rate": "game_id % 53 / 100e0", "fav_minutes_share_top6": "0.8e0 + game_id % 20 / 100e0",
    "fav_second_half_net_rating": "CAST(game_id % 23 AS DOUBLE)", "fav_first_half_net_rating": "CAST(game_id % 7 AS DOUBLE)", "fav_road_eff": "1e0 + game_id % 30 / 100e0", "fav_neutral_eff": "1e0 + game_id % 11 / 100e0",
    "fav_last8_actual_wins": "CAST(game_id % 9 AS DOUBLE)", "fav_last8_pythag_wins": "CAST(game_id % 5 AS DOUBLE)", "fav_two_pt_pct_rank": "CAST(game_id % 50 AS DOUBLE)", "dog_zone_rate": "game_id % 47 / 100e0",
    "fav_games_last_9_days": "CAST(game_id % 7 AS DOUBLE)", "dog_games_last_9_days": "CAST(game_id % 6 AS DOUBLE)", "fav_lost_conf_tourney_final": "CAST(game_id % 4 % 2 AS DOUBLE)",
    "fav_team": "CASE WHEN game_id % 9 = 0 THEN ' Duke ' WHEN game_id % 9 = 1 THEN NULL ELSE 'other' END", "spread": "line * 2", "round": "CASE game_id % 4 WHEN 0 THEN 'NCAA_R32' WHEN 1 THEN 'CONF_QF' WHEN 2 THEN 'NIT_R1' ELSE 'other' END",
}
_TEAM = {
    "adj_def_rank": "CASE WHEN game_id % 6 = 0 THEN NULL ELSE CAST(game_id % 40 AS DOUBLE) END", "players_with_tourney_game": "CAST(game_id % 8 AS DOUBLE)", "ft_pct": "0.6e0 + game_id % 25 / 100e0", "ft_rate_rank": "CAST(game_id % 90 AS DOUBLE)",
    "three_pa_rate": "0.2e0 + game_id % 31 / 100e0", "three_pt_possession_rate": "CASE WHEN game_id % 4 <> 0 THEN 0.15e0 + game_id % 43 / 100e0 END", "two_pt_pct": "0.4e0 + game_id % 19 / 100e0", "guard_scoring_assist_share": "game_id % 101 / 100e0", "sos_rank": "CAST(game_id % 61 AS DOUBLE)", "road_games_vs_top50": "CAST(game_id % 14 AS DOUBLE)",
    "win_streak_entering": "CAST(game_id % 13 AS DOUBLE)", "center_minutes_in_foul_trouble": "CAST(game_id % 37 AS DOUBLE)", "seed_inflation_score": "CAST(game_id % 11 AS DOUBLE)", "first_year_transfers": "CAST(game_id % 9 AS DOUBLE)",
    "tempo_rank": "CAST(game_id * 3 % 364 AS DOUBLE)", "faced_top40_pace_games": "CAST(game_id % 3 AS DOUBLE)", "coach_tourney_appearances": "CAST(game_id % 7 AS DOUBLE)", "conference_tournament_games": "CAST(game_id % 6 AS DOUBLE)",
}
_SITUATION = {
    "game_is_nit": "CAST(game_id % 3 % 2 AS DOUBLE)", "team_program_tier": "CASE game_id % 4 WHEN 0 THEN 'Power' WHEN 1 THEN NULL ELSE 'mid' END", "team_auto_bid": "CAST(game_id % 2 AS DOUBLE)", "team_conference_tourney_margin": "CAST(game_id % 30 - 12 AS DOUBLE)",
    "team_projected_in_ncaa_days": "CAST(game_id % 90 AS DOUBLE)", "game_crowd_support_pct": "game_id % 101 / 100e0", "team_travel_miles": "CAST(game_id * 17 % 2900 AS DOUBLE)", "team_timezone_changes": "CAST(game_id % 4 AS DOUBLE)",
    "game_site_altitude_ft": "CAST(game_id * 31 % 7000 AS DOUBLE)", "team_campus_altitude_ft": "CAST(game_id * 7 % 4000 AS DOUBLE)", "team_games_in_72h": "CAST(1 + game_id % 4 AS DOUBLE)", "team_avg_tipoff_local_hour": "CAST(12 + game_id % 10 AS DOUBLE)",
    "game_tipoff_local_hour": "CAST(11 + game_id % 12 AS DOUBLE)", "team_physicality_index": "game_id % 100 / 100e0", "game_crew_whistle_rate": "game_id * 3 % 100 / 100e0", "team_media_obligations_per_day": "CAST(game_id % 21 AS DOUBLE)",
    "game_is_first_four_followup": "CAST(game_id % 5 % 2 AS DOUBLE)", "team_hours_since_first_four": "CAST(game_id % 72 AS DOUBLE)", "game_campus_site_flag": "CAST(game_id % 7 % 2 AS DOUBLE)", "game_campus_site_home_edge": "game_id % 40 / 10e0",
    "game_rematch_controversial_flag": "CAST(game_id % 2 AS DOUBLE)", "team_lost_prior_meeting_flag": "CAST(game_id % 3 % 2 AS DOUBLE)", "team_selection_criticized_flag": "CAST(game_id % 11 % 2 AS DOUBLE)", "team_seniors_rotation_count": "CAST(game_id % 6 AS DOUBLE)",
}


def _inputs(columns: dict[str, str]) -> str:
    return f"i AS (SELECT game_id, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM games)"


def _made(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return games(spark, sf_dir).selectExpr("game_id", *[f"{e} AS {n}" for n, e in columns.items()])


def _finished(df: DataFrame, card: dict) -> DataFrame:
    """The card's columns; names in an array are joined for comparison."""
    df = df.withColumns(card)
    kinds = dict(df.dtypes)
    shown = {"double": lambda c: R(F.col(c)), "array<string>": lambda c: F.array_join(c, "|")}
    return df.select("game_id", *[shown.get(kinds[c], F.col)(c).alias(c) for c in card])


def _r(sql: str) -> str:
    return f"round({sql} + 3e-10, 6) + 0e0"


def _s(sql: str) -> str:
    return f"least(greatest({sql}, 0e0), 1e0)"


def _b(sql: str) -> str:
    return f"CASE WHEN {sql} THEN 1e0 ELSE 0e0 END"


def _tags(tests: dict[str, str]) -> str:
    return f"concat_ws('|', {', '.join(f'''CASE WHEN {t} THEN '{n}' END''' for n, t in tests.items())})"


_DOG = [
    _s("(dog_off_eff_rank - dog_def_eff_rank - 30) / 80"), _s("(fav_pace_rank - coalesce(dog_pace_rank, 175) - 30) / 140"), _s("(dog_ft_rate - fav_opp_ft_rate_allowed) / 0.15e0"), _b("dog_three_pt_def_rank <= 30 AND fav_three_pt_off_rank <= 30"),
    _s("(dog_off_reb_rate - fav_def_reb_rate + 0.05e0) / 0.15e0"), _b("dog_steal_rate_rank <= 40 AND dog_forced_to_rate_rank <= 40"), _b("dog_players_10plus_tourney_minutes_positive_pm >= 3"), _b("dog_high_volume_38pct_3pt_shooters >= 2"), _s("(dog_coach_dog_ats_score - 0.5e0) / 0.25e0"),
    _s("(dog_seed - dog_kenpom_equivalent_seed - 1) / 10"),
]


@query(f"""WITH {GAMES}, {_inputs(_SIDES)}, p AS (SELECT *, {', '.join(f'{v} AS p{k}' for k, v in enumerate(_DOG))} FROM i),
s AS (SELECT *, (1.1e0 * p0 + 1.35e0 * p1 + 1.15e0 * p2 + 0.8e0 * p3 + 0.9e0 * p4 + p5 + 0.85e0 * p6 + 0.75e0 * p7 + 0.8e0 * p8 + 1.2e0 * p9) / 9.9e0 AS score, 0.15e0 + least(abs(spread), 14) * 0.015e0 AS base,
  CASE round WHEN 'NCAA_R32' THEN 0.94e0 WHEN 'CONF_QF' THEN 1.03e0 WHEN 'NIT_R1' THEN 1.04e0 ELSE 1e0 END AS adj, dog_auto_bid = 1 AND fav_power_program_flag = 1 AND dog_seed >= 13 AND fav_seed <= 4 AND dog_seed - fav_seed >= 12 AS capped FROM p),
c AS (SELECT *, CASE WHEN capped THEN least({_s('base * (0.75e0 + score) * adj')}, 0.3e0) ELSE {_s('base * (0.75e0 + score) * adj')} END AS chance FROM s)
SELECT game_id, {_r('score')} AS dog_dna_score, {_r('chance')} AS upset_probability, CASE WHEN chance >= 0.5 THEN 'LIVE_DOG' WHEN chance >= 0.38 THEN 'VOLATILE_DOG' ELSE 'LONGSHOT_DOG' END AS upset_archetype_label,
{_tags({n: f'p{k} >= 0.6' for k, n in enumerate(p.name for p in U.UNDERDOG)})} AS key_upset_drivers, {_r('(chance - base) * abs(spread)')} AS market_edge_vs_spread, capped AS upset_probability_cap_triggered FROM c""")
def rules_upset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _made(spark, sf_dir, _SIDES)
    return _finished(df, U.upset(df, F.col("spread"), F.col("round")))


_FRAGILE = {
    "EFFICIENCY_CLIFF": _s("(fav_point_diff_rank - fav_kenpom_eff_rank - 30) / 90"), "TURNOVER_TIMEBOMB": _b("fav_turnover_rate_rank > 100 AND dog_forced_to_rate_rank <= 40"), "PERIMETER_EXPOSURE": _b("fav_three_pt_def_rank > 80 AND dog_three_pt_attempt_rate >= 0.4e0"),
    "DEPTH_ILLUSION": _s("(fav_minutes_share_top6 - 0.85e0) / 0.1e0"), "SLOW_START_TENDENCY": _s("(fav_second_half_net_rating - fav_first_half_net_rating - 5) / 12"), "ROAD_WARRIOR_FALSE": _s("(fav_road_eff - fav_neutral_eff - 0.05e0) / 0.2e0"),
    "RECENCY_TRAP": _s("(fav_last8_actual_wins - fav_last8_pythag_wins - 1) / 5"), "INTERIOR_DOMINANCE_FALLACY": _b("fav_two_pt_pct_rank <= 20 AND dog_zone_rate >= 0.25e0"),
}


@query(f"""WITH {GAMES}, {_inputs(_SIDES)}, p AS (SELECT *, {', '.join(f'{v} AS p{k}' for k, v in enumerate(_FRAGILE.values()))}, {_b('fav_games_last_9_days >= 5 AND dog_games_last_9_days <= 3')} AS tired, {_b('fav_lost_conf_tourney_final = 1')} AS lost FROM i),
x AS (SELECT *, (p0 + p1 + p2 + p3 + p4 + p5 + p6 + p7) / 8 AS idx FROM p), e AS (SELECT *, {_s('0.08e0 + idx * 0.55e0 + tired * 0.08e0 + lost * 0.04e0')} AS one, {_s('0.14e0 + idx * 0.45e0 + tired * 0.05e0')} AS two FROM x)
SELECT game_id, {_r('idx')} AS fragility_index, {_r('greatest(one, two)')} AS early_exit_probability, {_r('one')} AS first_round_exit_probability, {_r('two')} AS second_round_exit_probability, {_tags({n: f'p{k} >= 0.55' for k, n in enumerate(_FRAGILE)})} AS fragility_drivers,
{_r("CASE WHEN lower(trim(fav_team)) IN ('duke', 'kentucky', 'kansas', 'north carolina', 'gonzaga') THEN 1.25e0 ELSE 0e0 END")} AS brand_tax_points, CASE WHEN idx >= 0.55 THEN 'fade' WHEN idx >= 0.35 THEN 'monitor' ELSE 'avoid' END AS recommended_action FROM e""")
def rules_fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _made(spark, sf_dir, _SIDES)
    return _finished(df, U.fragility(df))


_WINS = {
    "ELITE_DEFENSE_WINS": ("coalesce(adj_def_rank, 999) <= 15", "1 - least(coalesce(adj_def_rank, 999), 120) / 120"), "EXPERIENCED_MARCH": ("players_with_tourney_game >= 4", "players_with_tourney_game / 6"),
    "FREE_THROW_CLUTCH": ("ft_pct > 0.75e0 AND ft_rate_rank <= 40", "((ft_pct - 0.7e0) / 0.15e0 + (40 - least(ft_rate_rank, 40)) / 40) / 2"), "LOW_VARIANCE_OFFENSE": ("three_pa_rate < 0.35e0 AND two_pt_pct >= 0.52e0", "(0.4e0 - least(three_pa_rate, 0.4e0)) * 1.8e0 + greatest(0e0, two_pt_pct - 0.5e0)"),
    "GUARD_DOMINANT": ("guard_scoring_assist_share >= 0.6e0", "guard_scoring_assist_share"), "BATTLE_TESTED_SCHEDULE": ("sos_rank <= 25 AND road_games_vs_top50 >= 8", "((25 - least(sos_rank, 25)) / 25 + least(road_games_vs_top50, 12) / 12) / 2"),
    "HOT_HAND_ENTRY": ("win_streak_entering >= 7", "win_streak_entering / 12"),
}
_FAILS = {
    "THREE_POINT_DEPENDENT": ("coalesce(three_pt_possession_rate, three_pa_rate) >= 0.4e0", "coalesce(three_pt_possession_rate, three_pa_rate)"), "ONE_BIG_DEPENDENT": ("center_minutes_in_foul_trouble < 25", "(25 - center_minutes_in_foul_trouble) / 25"), "SOFT_SCHEDULE_FRAUD": ("seed_inflation_score > 3", "greatest(0e0, seed_inflation_score - 3) / 6"),
    "TRANSFER_PORTAL_CHAOS": ("first_year_transfers >= 4", "first_year_transfers / 8"), "STYLE_MISMATCH_VULNERABLE": ("tempo_rank > 250 AND faced_top40_pace_games = 0", "(tempo_rank - 250) / 113"), "COACH_FIRST_RODEO": ("coach_tourney_appearances <= 2", "(3 - coach_tourney_appearances) / 3"),
    "CONFERENCE_TOURNEY_EXHAUSTED": ("conference_tournament_games >= 4", "conference_tournament_games / 6"),
}


def _each(group: dict[str, tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {t} THEN '{n}:' || CAST(floor({_s(v)} * 1000 + 1e-6) AS BIGINT) END" for n, (t, v) in group.items()) + ")"


@query(f"WITH {GAMES}, {_inputs(_TEAM)} SELECT game_id, {_each(_WINS)} AS winning, {_each(_FAILS)} AS failing FROM i")
def rules_archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archetypes that a team shows, each with its confidence in thousandths."""
    df = _made(spark, sf_dir, _TEAM)
    df = df.withColumns(U.archetypes(df))

    def shown(c: str):
        return F.array_join(F.transform(F.filter(c, lambda x: x["label"]), lambda x: F.concat(x["name"], F.lit(":"), F.floor(x["confidence"] * 1000 + 1e-6).cast("string"))), "|")

    return df.select("game_id", shown("winning_archetypes").alias("winning"), shown("failure_archetypes").alias("failing"))


_WEAR = {
    "TRAVEL_BURDEN_SCORE": (_s("team_travel_miles / 2200 + team_timezone_changes * 0.15e0"), 0.60), "ALTITUDE_ADJUSTMENT": (_s("(game_site_altitude_ft - team_campus_altitude_ft) / 5000"), 0.55), "BACK_TO_BACK_FATIGUE_PATTERN": (_s("(team_games_in_72h - 2) / 2"), 0.45),
    "TIP_TIME_MISMATCH": (_s("abs(team_avg_tipoff_local_hour - game_tipoff_local_hour) / 9"), 0.50), "OFFICIATING_STYLE_MISMATCH": (_s("abs(team_physicality_index - game_crew_whistle_rate)"), 0.60), "MEDIA_PRESSURE_OVERLOAD": (_s("(team_media_obligations_per_day - 8) / 10"), 0.45),
    "FIRST_FOUR_SHORT_REST": (f"CASE WHEN game_is_first_four_followup = 1 THEN {_s('(36 - team_hours_since_first_four) / 24')} ELSE 0e0 END", 0.45), "CAMPUS_SITE_HOSTILE_ENVIRONMENT": (f"CASE WHEN game_campus_site_flag = 1 THEN {_s('game_campus_site_home_edge / 3')} ELSE 0e0 END", 0.45),
}


@query(f"""WITH {GAMES}, {_inputs(_SITUATION)}, p AS (SELECT *, {', '.join(f'{v} AS w{k}' for k, (v, _) in enumerate(_WEAR.values()))}, CASE WHEN game_is_nit = 1 THEN {_s(_s('(team_projected_in_ncaa_days - 20) / 35') + " * CASE WHEN lower(team_program_tier) IN ('blue_blood', 'power') THEN 1.2e0 ELSE 0.8e0 END")} ELSE 0e0 END AS down,
  least(greatest((game_crowd_support_pct - 0.5e0) / 0.2e0, -1), 1) AS crowd, CASE WHEN team_auto_bid = 1 THEN {_s('(team_conference_tourney_margin + 8) / 16')} ELSE 0e0 END AS relief FROM i),
q AS (SELECT *, ({_b('team_selection_criticized_flag = 1')} + {_b('team_seniors_rotation_count >= 3')} + relief + {_b('game_rematch_controversial_flag = 1 AND team_lost_prior_meeting_flag = 1')} + greatest(crowd, 0)) / 5 AS lift, (down + {' + '.join(f'w{k}' for k in range(8))} + greatest(-crowd, 0)) / 10 AS drag FROM p)
SELECT game_id, {_r('least(greatest(lift - drag, -1), 1)')} AS situational_edge_score, true AS points_follow, CASE WHEN lift >= 0.6 THEN 'HIGH_DOG' WHEN down > 0.55 THEN 'LOW_MOTIVATION' ELSE 'NEUTRAL' END AS motivation_flag,
{_r(_s('1 - (w0 + w1 + w2 + w3) / 4'))} AS physical_state_rating, {_tags({n: f'w{k} > {x}' for k, (n, (_, x)) in enumerate(_WEAR.items())})} AS contextual_risk_flags FROM q""")
def rules_situational(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _made(spark, sf_dir, _SITUATION)
    card = U.situational(df)
    # Points are rounded to two places, at which engines settle ties differently.
    points = card.pop("situational_adjustment_points")
    return _finished(df, card | {"points_follow": F.abs(points - card["situational_edge_score"] * 2.5) <= 0.005 + 1e-9})


@query(f"""WITH {GAMES}, k AS (SELECT game_id, pred / 20 AS composite, game_id % 9 / 10e0 AS shop, CASE WHEN odds > 0 THEN odds / 100 ELSE -100 / odds END AS b, conf AS p FROM games WHERE odds IS NOT NULL),
f AS (SELECT *, greatest(0e0, (b * p - (1 - p)) / b) AS kelly FROM k), s AS (SELECT *, least(kelly * 0.25e0, 0.05e0) AS stake FROM f)
SELECT game_id, {_r('stake')} AS kelly_recommended, {_r('stake')} AS max_bet, CASE WHEN composite >= 2 THEN 'A' WHEN composite >= 1 THEN 'B' ELSE 'C' END AS tier,
CASE WHEN composite >= 1.5 AND shop >= 0.25 THEN 'bet now' WHEN composite >= 1 THEN 'wait for sharp action' ELSE 'avoid late' END AS timing, abs(composite) >= 3 AS hedge, {_r('p * (0.6e0 + 0.4e0 * pow(0.5e0, (game_id % 60) / 24e0))')} AS confidence FROM s""")
def rules_bet_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir).where("odds IS NOT NULL")
    card = U.bet_card(F.col("pred") / 20, O.kelly(F.col("conf"), F.col("odds")), F.col("game_id") % 9 / 10)
    return _finished(g, card | {"confidence": U.decayed_confidence(F.col("conf"), F.col("game_id") % 60)})


@query(f"""WITH {GAMES}, i AS (SELECT *, CASE game_id % 3 WHEN 0 THEN -0.015e0 WHEN 1 THEN -0.035e0 ELSE -0.02e0 END + CASE game_id % 2 WHEN 0 THEN -0.015e0 ELSE -0.01e0 END AS d, greatest(55, (h_poss + a_poss) / 2 - 2 - game_id % 3) AS n FROM games),
p AS (SELECT *, greatest(0.75e0, (h_ortg / 100 + 1.05e0) / 2 + d + game_id % 5 / 100e0) AS a, greatest(0.75e0, (a_ortg / 100 + 0.95e0) / 2 + d) AS b FROM i), t AS (SELECT *, (a + b) * n + 1.5e0 AS total FROM p)
SELECT game_id, {_r('n')} AS possessions, CAST(round_even(n - CASE WHEN n < 68 THEN 4 ELSE 5 END, 0) AS BIGINT) AS possessions_low, CAST(round_even(n + CASE WHEN n < 68 THEN 4 ELSE 5 END, 0) AS BIGINT) AS possessions_high, {_r('d')} AS deflator, {_r('a')} AS ppp_a, {_r('b')} AS ppp_b, {_r('total')} AS total,
CAST(round_even(total - 6, 0) AS BIGINT) AS total_low, CAST(round_even(total + 6, 0) AS BIGINT) AS total_high, {_r('total * 0.485e0 - 1')} AS first_half, {_r('total * 0.515e0 + 1.25e0')} AS second_half, {_r('2400 / greatest(30e0, 2400 / n)')} AS shot_clock FROM t""")
def rules_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir)
    round_ = F.when(F.col("game_id") % 3 == 0, "Opening").when(F.col("game_id") % 3 == 1, "final_4").otherwise("unknown")
    tier = F.when(F.col("game_id") % 2 == 0, "mid_major").otherwise("unknown")
    more = {"fatigue": -(F.col("game_id") % 3).cast("double"), "premium_a": (F.col("game_id") % 5).cast("double"), "venue": 1.5, "lead": 0.25}
    return _finished(g, U.totals(F.col("h_poss"), F.col("a_poss"), F.col("h_ortg") / 100, F.lit(0.95), F.col("a_ortg") / 100, F.lit(1.05), round_, tier, **more))


_CONFERENCE = {
    "dog_dna_score_conf": "CASE WHEN game_id % 6 = 0 THEN NULL ELSE game_id % 120 / 100e0 END", "third_meeting_adjustment": "CAST(game_id % 5 - 2 AS DOUBLE)", "fatigue_differential": "CAST(game_id % 4 - 1 AS DOUBLE)", "press_break_mismatch": "CAST(game_id % 2 AS DOUBLE)",
    "a_load_management_risk": "CASE WHEN game_id % 3 = 0 THEN NULL ELSE game_id % 90 / 80e0 END", "a_load_management_probability": "game_id % 70 / 100e0", "a_game_3_fatigue_wall_score": "game_id % 83 / 80e0", "a_key_player_dependency_score": "game_id % 77 / 80e0",
    "a_bracket_motivation_score": "game_id % 50 / 50e0", "b_situational_adjustment_points": "CAST(game_id % 31 - 12 AS DOUBLE)", "archetype_alignment_conf": "game_id % 9 / 2e0", "clv_validation_years": "CAST(3 + game_id % 6 AS DOUBLE)", "market_implied_edge": "game_id % 13 / 10e0",
    "market_spread": "line / 2", "conference": "CASE game_id % 4 WHEN 0 THEN ' ACC' WHEN 1 THEN 'wcc' WHEN 2 THEN 'mac' END", "tournament_round": "CASE game_id % 3 WHEN 0 THEN 'Semifinal' WHEN 1 THEN 'Final' END", "b_team": "CASE WHEN game_id % 2 = 0 THEN 'Dogs' END",
    "a_revenge_score": "game_id % 100 / 100e0", "a_conf_tourney_coach_alpha": "CAST(game_id % 3 - 1 AS DOUBLE)", "a_motivation_clarity_score": "CASE WHEN game_id % 7 <> 0 THEN CAST(game_id % 11 AS DOUBLE) END", "a_depth_vs_field_advantage": "game_id % 30 / 10e0 - 1", "a_first_year_transfers": "CAST(game_id % 6 AS DOUBLE)",
}
_LOAD = _s("coalesce(a_load_management_risk, a_load_management_probability)")
_SIGNED = "CASE WHEN {v} < 0 THEN '-' ELSE '+' END || regexp_replace(CAST(abs({v}) AS VARCHAR), '\\.0$', '')"


@query(f"""WITH {GAMES}, {_inputs(_CONFERENCE)}, p AS (SELECT *, {_s('coalesce(dog_dna_score_conf, 0.5e0)')} AS dog, {_LOAD} AS ld, {_s('a_game_3_fatigue_wall_score')} AS wall, {_s('a_key_player_dependency_score')} AS kp, a_bracket_motivation_score AS br FROM i),
f AS (SELECT *, {_s('0.45e0 * ld + 0.25e0 * wall + 0.2e0 * kp + 0.1e0 * (1 - br)')} AS fr, CASE game_id % 4 WHEN 0 THEN 'power6' WHEN 1 THEN 'high_major_mid_major' WHEN 2 THEN 'true_mid_major' ELSE 'low_major' END AS tier, CASE game_id % 4 WHEN 0 THEN 2e0 WHEN 3 THEN 1e0 ELSE 1.5e0 END AS least_edge FROM p),
e AS (SELECT *, CASE WHEN clv_validation_years >= 5 THEN 0.15e0 * archetype_alignment_conf + 0.13e0 * dog + 0.16e0 * fr + 0.2e0 * b_situational_adjustment_points + 0.12e0 * third_meeting_adjustment + 0.24e0 * ld - market_implied_edge ELSE 0 END AS edge FROM f)
SELECT game_id, CASE WHEN a_revenge_score >= 0.65 THEN 'REVENGE_MACHINE' WHEN a_conf_tourney_coach_alpha > 0 THEN 'CONF_TOURNEY_SPECIALIST' WHEN coalesce(a_motivation_clarity_score, 5) >= 8 THEN 'MOTIVATION_CLARITY' WHEN a_depth_vs_field_advantage >= 1 THEN 'DEPTH_ADVANTAGE_FORMAT' ELSE 'NONE' END AS archetype_a,
CASE WHEN a_first_year_transfers >= 4 THEN 'TRANSFER_PORTAL_CHAOS' ELSE '' END AS failing_a, {_r(_s('0.25e0 + 0.35e0 * dog + 0.08e0 * third_meeting_adjustment + 0.04e0 * fatigue_differential'))} AS upset_prob, CASE WHEN fatigue_differential > third_meeting_adjustment THEN 'FATIGUE_BASED_UPSET' ELSE 'THIRD_MEETING_EDGE' END AS upset_archetype,
{_tags({'third_meeting_motivation_asymmetry': 'third_meeting_adjustment > 0', 'fatigue_differential': 'fatigue_differential > 0', 'PRESS_BREAK_OR_DIE': 'press_break_mismatch <> 0'})} AS key_upset_drivers, {_r('fr')} AS fragility_index, CASE WHEN br < 0.5 THEN 'low' ELSE 'high' END AS bracket_motivation,
{_tags({'LOAD_MANAGEMENT_EXPOSURE': 'ld >= 0.5', 'THIRD_GAME_IN_FOUR_DAYS_WALL': 'wall >= 0.5', 'KEY_PLAYER_DEPENDENCY': 'kp >= 0.5', 'BRACKET_KNOWLEDGE_TRAP': 'br <= 0.4'})} AS fragility_drivers, {_r('edge')} AS edge,
CASE WHEN edge >= least_edge THEN coalesce(b_team, 'Team B') || ' ' || {_SIGNED.format(v='(-market_spread)')} WHEN edge <= -least_edge THEN 'Team A ' || {_SIGNED.format(v='market_spread')} ELSE 'pass' END AS recommended_bet,
CASE WHEN edge >= least_edge + 1 THEN 'A' WHEN edge >= least_edge THEN 'B' ELSE 'C' END AS confidence_tier, CASE game_id % 3 WHEN 0 THEN 0.75e0 WHEN 1 THEN 1e0 ELSE 0.5e0 END AS max_bet_units, CASE WHEN fr >= 0.45 OR kp >= 0.55 THEN 'star foul trouble trigger active' ELSE 'none' END AS live_bet_watch, tier FROM e""")
def conference_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _made(spark, sf_dir, _CONFERENCE)
    c = CF.card(df)
    out = {k: c[k] for k in ("archetype_a", "failing_a", "upset_prob", "upset_archetype", "key_upset_drivers", "fragility_index", "bracket_motivation", "fragility_drivers", "recommended_bet", "confidence_tier", "max_bet_units", "live_bet_watch", "edge")}
    return _finished(df, out | {"tier": c["conference_tier_adjustment"]})
