"""Rule cards on rows with the published column names, with few of the columns, and with others' names."""

import pytest
from pyspark.sql import functions as F

from tipline.operators import conference, rules


def one(df, card):
    return df.select(*[c.alias(n) for n, c in card.items()]).first()


def test_missing_columns_take_their_defaults(spark):
    df = spark.range(1).withColumn("x", F.lit(1))
    u = one(df, rules.upset(df, F.lit(10.0), F.lit("NCAA_R64")))
    # Only the rebounding part has a value: 0.05 / 0.15, weighted 0.9 of 9.9 in all.
    score = 0.9 / 3 / 9.9
    assert (u.dog_dna_score, u.upset_probability, u.key_upset_drivers, u.upset_probability_cap_triggered) == (pytest.approx(score), pytest.approx(0.3 * (0.75 + score)), [], False)
    f = one(df, rules.fragility(df))
    assert (f.fragility_index, f.recommended_action, f.brand_tax_points) == (0.0, "avoid", 0.0)
    assert (f.first_round_exit_probability, f.second_round_exit_probability, f.early_exit_probability) == (pytest.approx(0.08), pytest.approx(0.14), pytest.approx(0.14))
    a = one(df, rules.archetypes(df))
    assert [x.name for x in a.winning_archetypes if x.label] == [] and [x.name for x in a.failure_archetypes if x.label] == []
    assert {x.name: x.confidence for x in a.winning_archetypes}["ELITE_DEFENSE_WINS"] == 0.0
    s = one(df, rules.situational(df))
    assert (s.situational_edge_score, s.motivation_flag, s.physical_state_rating, s.contextual_risk_flags) == (0.0, "NEUTRAL", 1.0, [])


def test_cap_on_small_champions(spark):
    rows = [(15, 2, 1, 1), (15, 2, 1, 0), (13, 2, 1, 1), (None, 2, 1, 1)]
    df = spark.createDataFrame(rows, "dog_seed int, fav_seed int, dog_auto_bid int, fav_power_program_flag int").withColumn("dog_kenpom_equivalent_seed", F.lit(1))
    got = df.select(*[c.alias(n) for n, c in rules.upset(df, F.lit(-14.0), F.lit("CONF_QF")).items()]).collect()
    assert [r.upset_probability_cap_triggered for r in got] == [True, False, False, False]
    assert got[0].upset_probability == 0.30 and got[1].upset_probability > 0.30


def test_names_and_sides_are_parameters(spark):
    df = spark.createDataFrame([(10.9, 60.0, 0.55, None)], "def_rank double, two double, three double, three_pt_possession_rate double")
    a = one(df, rules.archetypes(df, names={"adj_def_rank": "def_rank", "two_pt_pct": "two", "three_pa_rate": "three"}))
    win, fail = ({x.name: x for x in group} for group in (a.winning_archetypes, a.failure_archetypes))
    assert win["ELITE_DEFENSE_WINS"].label and win["ELITE_DEFENSE_WINS"].confidence == pytest.approx(1 - 10 / 120)  # ranks are whole numbers
    assert fail["THREE_POINT_DEPENDENT"].label and fail["THREE_POINT_DEPENDENT"].confidence == pytest.approx(0.55)  # stands in for the missing rate
    home = spark.createDataFrame([(3000.0, 2.0, "Power", 1, 60.0)], "home_travel_miles double, home_timezone_changes double, home_program_tier string, game_is_nit int, home_projected_in_ncaa_days double")
    s = one(home, rules.situational(home, team="home_"))
    assert s.contextual_risk_flags == ["TRAVEL_BURDEN_SCORE"] and s.motivation_flag == "LOW_MOTIVATION"
    assert s.situational_edge_score == pytest.approx(-0.2) and s.situational_adjustment_points == -0.5 and s.physical_state_rating == pytest.approx(0.75)


def test_base_rates_of_past_teams(spark):
    rows = [(3, 1, 1), (10, 1, 0), (15, 0, None), (16, 1, 1), (None, 1, 1)]
    got = rules.defence_base_rates(spark.createDataFrame(rows, "adj_def_rank int, made_final_four int, won_championship int")).first()
    assert (got.final_four_rate, got.championship_rate) == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert tuple(rules.defence_base_rates(spark.createDataFrame([], "adj_def_rank int")).first()) == (0.0, 0.0)


def test_conference_card_without_figures(spark):
    df = spark.createDataFrame([("Big East", "Championship Final"), (None, None)], "conference string, tournament_round string")
    big, none = df.select(*[c.alias(n) for n, c in conference.card(df).items()]).collect()
    assert (big.conference_tier_adjustment, big.max_bet_units, big.timing, big.recommended_bet) == ("power6", 1.0, "bet now — open_to_4hrs_before", "pass")
    assert (none.conference_tier_adjustment, none.max_bet_units, none.archetype_a, none.failing_a) == ("low_major", 0.5, "NONE", [])
    # Half the dog's score and half a motivated bracket are the defaults.
    assert big.upset_prob == pytest.approx(0.25 + 0.175) and big.fragility_index == pytest.approx(0.05) and big.composite_edge == pytest.approx(round(0.13 * 0.5 + 0.16 * 0.05, 3))
    assert tuple(big.survives_b) == (0.35, 0.4, 0.22, 0.12) and big.bracket_motivation == "high" and big.kelly_recommended == pytest.approx(0.001)


def test_conference_bets_name_the_side(spark):
    rows = [("a", "b", 3.5, 20.0, 6, "mac"), ("a", "b", -3.0, -20.0, 6, "mac"), ("a", "b", 3.5, 20.0, 4, "mac")]
    df = spark.createDataFrame(rows, "a_team string, b_team string, market_spread double, b_situational_adjustment_points double, clv_validation_years int, conference string")
    got = [r[0] for r in df.select(conference.card(df)["recommended_bet"]).collect()]
    assert got == ["b -3.5", "a -3", "pass"]
