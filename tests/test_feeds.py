"""Feeds, sinks, names, prices and profiles on rows made for the purpose."""

import pytest
from pyspark.sql import functions as F

from tipline.functions import betting, columns, text
from tipline.operators import aggregates, quality
from tipline.sources import files, nested


def test_odds_of_odd_shapes(spark):
    texts = [None, "", "[]", "{", '{"odds":{}}', '{"odds":[7]}', '{"odds":[{"homeTeamOdds":{},"homeOdds":"x","homeMoneyLine":" 120.7 ","awayTeamOdds":{"moneyline":"-3e2"}}]}', '{"odds":[{"spread":true,"overUnder":null,"details":0,"displayValue":"shown"}]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [r.o for r in df.select("i", nested.odds(nested.parsed(F.col("t"))).alias("o")).orderBy("i").collect()]
    assert all(list(r) == [None] * 6 for r in rows[:6])
    assert (rows[6].home_moneyline, rows[6].away_moneyline) == (120, -300)
    assert (rows[7].odds_details, rows[7].spread, rows[7].over_under) == ("shown", None, None)


def test_stat_tables_and_injuries_of_odd_shapes(spark):
    texts = [None, "{}", '[{"labels":["a","b"],"stats":[1]},{"name":"c","value":2},{"labels":"x"},[],{"name":"a","displayValue":"last"}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    maps = [r.m for r in df.select("i", nested.stat_map(nested.items(nested.parsed(F.col("t")), ".")).alias("m")).orderBy("i").collect()]
    assert maps == [{}, {}, {"a": "last", "c": "2"}]
    teams = [None, '{"team":{"injuries":[]},"athletes":[{"id":4,"injuries":[{"type":{"name":"Back"},"details":{}}]}]}', '{"injuries":[1,{"athlete":"x"},{"athlete":{"id":null,"position":{}}}]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(teams)], "i int, t string")
    rows = [r.x for r in df.select("i", nested.injuries(nested.parsed(F.col("t"))).alias("x")).orderBy("i").collect()]
    assert rows[0] == [] and [(r.athlete_id, r.injury_type, r.team) for r in rows[1]] == [("4", "Back", "Unknown")]
    assert [(r.athlete_id, r.player, r.position) for r in rows[2]] == [("", "Unknown", "")]


def test_reports_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b", 1, 0.5), ("c", None, None)], "k string, n long, x double")
    for kind in ("json", "csv"):
        for _ in range(2):  # a report replaces the one before
            files.report(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, files.read_report(spark, f"{tmp_path}/{kind}", kind, df.schema).collect())) == sorted(map(tuple, df.collect()))
        assert len(list((tmp_path / kind).glob("part-*"))) == 1


def test_row_counts_of_a_catalogue(spark):
    one, none = spark.range(3), spark.range(0)
    got = quality.row_counts(spark, {"raw": one, "public": none, "lonely": none, "gone": None, "late": one}, {"public": "raw", "late": "gone"})
    assert {r.name: (r.present, r.n_rows, r.status) for r in got.collect()} == {
        "raw": (True, 3, "ok"), "public": (True, 0, "empty, but raw has rows"), "lonely": (True, 0, "empty"), "gone": (False, None, "missing"), "late": (True, 3, "ok"),
    }


def test_flags_and_columns_beside(spark):
    df = spark.createDataFrame([(" TRUE", 1.0), ("no", 0.0), (None, None)], "a string, b double")
    assert [tuple(r) for r in df.select(columns.flag(df, "a"), columns.flag(df, "b"), columns.flag(df, "c")).collect()] == [(True, True, True), (False, False, True), (False, False, True)]
    wide = columns.beside(spark.createDataFrame([(1, (2, 3))], "k int, s struct<k int, v int>"), "s")
    assert wide.columns == ["k", "v"] and tuple(wide.first()) == (1, 3)


def test_prices_that_are_none(spark):
    df = spark.createDataFrame([(150.0,), (-200.0,), (0.0,), (None,)], "o double")
    assert [r[0] for r in df.select(betting.implied_or(F.col("o"), "zero")).collect()] == pytest.approx([0.4, 2 / 3, 0.0, 0.0])
    assert [r[0] for r in df.select(betting.implied_or(F.col("o"), "null")).collect()][2:] == [None, None]
    assert df.where("o > 100").select(betting.implied_or(F.col("o"), "raise")).first()[0] == pytest.approx(0.4)
    with pytest.raises(Exception, match="no American odds"):
        df.select(betting.implied_or(F.col("o"), "raise")).collect()
    bets = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (None,)], "p double")
    assert betting.sharpe(bets, "p").first().sharpe == pytest.approx((2 / 3) / (14 / 9) ** 0.5 * 3**0.5)
    assert betting.sharpe(bets.limit(0), "p").first().sharpe == 0.0


def test_names(spark):
    df = spark.createDataFrame([("  Miami   (OH)",), ("Hawai'i",), ("San José St.",), (None,), ("&",)], "n string")
    assert [r[0] for r in df.select(text.team_key(F.col("n"))).collect()] == ["miami ohio", "hawai'i", "san josé st", "", "and"]
    assert len(text.TEAM_ALIASES) == 41


def test_profiles_of_parts_add_up(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("note", F.when(F.col("l_partkey") % 3 == 0, F.repeat(F.lit("é"), (F.col("l_partkey") % 50).cast("int"))))
    names = ["l_partkey", "l_extendedprice", "note"]
    whole = {r.column: r for r in aggregates.merged_profile(aggregates.profile_parts(lines, names, [])).collect()}
    parts = aggregates.profile_parts(lines, names, ["l_linenumber", "l_returnflag"])
    assert parts.count() > 10
    merged = {r.column: r for r in aggregates.merged_profile(parts).collect()}
    for c in names:
        exact = lines.select(F.col(c).cast("string").alias("t")).agg(
            F.count_distinct("t").alias("n_distinct"), F.avg(F.length("t")).alias("mean"), F.percentile(F.length("t"), F.lit(0.95)).alias("p95"), F.max(F.length("t")).alias("longest"), F.sum(F.octet_length("t")).alias("bytes"), F.avg(F.col("t").isNull().cast("double")).alias("missing")
        ).first()
        for got in (merged[c], whole[c]):
            assert got.n_distinct == pytest.approx(exact.n_distinct, rel=0.03) and got.p95_length == pytest.approx(exact.p95, abs=2)
            assert (got.max_length, got.bytes) == (exact.longest, exact.bytes) and [got.mean_length, got.missing] == pytest.approx([exact.mean, exact.missing])
    empty = aggregates.merged_profile(aggregates.profile_parts(lines.limit(0), names, []))
    assert empty.count() == 0


def test_validation_of_odd_tables(spark):
    S = quality.Spec
    found = lambda df, *a, **k: {(r.code, r.column): (r.value, r.severity) for r in quality.validate(df, *a, **k).collect()}
    assert found(spark.createDataFrame([], "a int"), [S("b", "text", True)]) == {("empty_df", ""): (0.0, "error")}
    df = spark.createDataFrame([("x", "{", "yes", "5", None, 1.0), ("y", '{"a":1}', "0", "z", None, float("nan"))], "n string, j string, f string, t string, e string, final_score double")
    got = found(df, [S("n", "number", True), S("j", "json"), S("f", "flag"), S("t", "time"), S("e", "json"), S("final_score", "number", low=2.0)], ["n", "j"])
    assert got == {
        ("min_rows", ""): (2.0, "warning"), ("dtype_coerce_failed", "n"): (0.0, "warning"), ("dtype_coerce_failed", "j"): (0.5, "warning"), ("high_null_rate", "e"): (1.0, "warning"),
        ("range_violation", "final_score"): (1.0, "warning"), ("leakage_token_hits", "final_score"): (1.0, "warning"),
    }
    assert found(df, [], ["n"], {"n": ["x"], "absent": [1]}, least_rows=1) == {("invalid_values", "n"): (1.0, "error"), ("leakage_token_hits", "final_score"): (1.0, "warning")}


def test_statistics_are_read_once(spark):
    """Spark puts an expression wherever it is used: without care every list is read again for each of its entries."""
    plan = spark.createDataFrame([], "t string").select(nested.stat_map(nested.items(nested.parsed(F.col("t")), ".")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get(") < 40
