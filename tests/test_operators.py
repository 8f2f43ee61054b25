"""Small fixtures for what no SQL twin covers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipline.functions import basketball, betting, columns, text
from tipline.operators import aggregates, joins, models, quality, windows
from tipline.sources import files


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("7.9", 7), ("--", -1), ("", -1), ("NaN", -1), ("-3.9", -3), (None, -1)])
def test_whole(spark, value, want):
    assert _one(spark, columns.whole(F.lit(value).cast("string"), -1)) == want


@pytest.mark.parametrize(("value", "want"), [(True, True), ("True", True), (" False", False), ("1.0", True), ("0.0", False), (None, False)])
def test_truthy(spark, value, want):
    assert _one(spark, columns.truthy(F.lit(value))) is want


def test_formulas(spark):
    lit = F.lit
    assert _one(spark, basketball.possessions_oliver(lit(60), lit(16), lit(12), lit(10), lit(7))) == pytest.approx(60 + 0.475 * 16 - 12 + 10 + 7 * 0.33)
    assert _one(spark, basketball.overtimes(lit("Final/2OT"))) == 2
    assert _one(spark, basketball.overtimes(lit("Final/OT"))) == 1
    assert _one(spark, basketball.overtimes(lit("Final"))) == 0
    assert _one(spark, betting.implied(lit(150.0))) == pytest.approx(0.4)
    assert _one(spark, betting.implied(lit(0.0))) is None
    assert _one(spark, betting.ats_result(lit(3.0), lit(-3.0), lit("home"))) == 0.5
    assert _one(spark, text.name_key(lit(" St. John's & Co ")), ) == "st john's and co"


def test_rolling_skips_gaps_and_the_current_row(spark):
    rows = [("a", i, None if i == 2 else float(i)) for i in range(6)]
    got = windows.pack(spark.createDataFrame(rows, "team string, t int, y double"), ["y"], ["team"], ["t"]).orderBy("t").collect()
    assert [r.y_l3_pre for r in got] == [None, 0.0, 0.5, 0.5, 2.0, 3.5]
    assert [r.games_pre for r in got] == [0, 1, 2, 2, 3, 4]
    assert got[1].y_std_l7_pre is None and got[2].y_std_l7_pre == 0.5


def test_same_day_rows_share_the_schedule_before(spark):
    rows = [("a", 1, 1, 10.0, 0.0), ("a", 2, 2, -4.0, None), ("a", 2, 3, 6.0, 0.0), ("a", 3, 4, None, 20.0)]
    df = spark.createDataFrame(rows, "team string, day int, id int, margin double, rating double")
    got = [r.s_weighted_margin for r in windows.schedule(df, "day", "margin", "rating", ["team"], ["day", "id"], 5, "s").orderBy("id").collect()]
    assert got == [0.0, 10.0, 10.0, 4.0]


def test_opponent_join_is_repeatable_and_takes_one_row_per_side(spark):
    df = spark.createDataFrame([(1, "home", 5, 1), (1, "away", 7, 1), (1, "away", 9, 2), (2, "home", 3, 1), (3, None, 1, 1)], "e int, s string, p int, seen int")
    once = joins.opponent(df, "e", "s", ["p"], [F.desc("seen")])
    twice = joins.opponent(once, "e", "s", ["p"], [F.desc("seen")])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    got = {(r.e, r.s, r.p): (r.opp_p, r.opp_join_ok) for r in once.collect()}
    assert got == {(1, "home", 5): (9, True), (1, "away", 7): (5, True), (1, "away", 9): (5, True), (2, "home", 3): (None, False), (3, None, 1): (None, False)}


def test_asof_is_strict(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40)], "k string, u int, v int")
    got = {(r.k, r.t): r.asof_v for r in joins.asof(left, right, "k", "t", "u", ["v"], ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 10, ("a", 9): 40, ("b", 5): None}


def test_upsert_never_replaces_a_value_by_null(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "k int, v int, w string")
    new = spark.createDataFrame([(1, None, "z"), (3, 7, None)], "k int, v int, w string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"]).collect())) == [(1, 5, "z"), (2, None, "b"), (3, 7, None)]


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=50) / 10
    df = spark.createDataFrame([(float(a), float(b), 4.0, float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, same double, y double")
    w = models.ridge(df, ["a", "b", "same"], "y", 0.5)
    d = np.c_[np.ones(50), x]
    want = np.linalg.solve(d.T @ d + np.diag([0, 0.5, 0.5]), d.T @ y)
    assert np.allclose([w["one"], w["a"], w["b"]], want) and w["same"] == 0.0


def test_splits_keep_the_order(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "t int")
    got = {r.t: r.split for r in models.chronological(df, ["t"]).collect()}
    assert [got[i] for i in range(10)] == ["train"] * 6 + ["val"] * 2 + ["test"] * 2


def test_buckets_are_right_open(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (20.0,), (None,)], "e double")
    got = {r.bucket: r.n for r in aggregates.bucketed(df, "e", []).collect()}
    assert got == {"0-2": 1, "2-5": 1, "5-10": 0, "10-20": 0, "20+": 1, "nan": 1}


def test_append_keeps_the_best_row(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    score = F.when(F.col("v").isNotNull(), 1).otherwise(0)
    for rows in ([(1, 5, 1), (2, None, 1)], [(1, None, 2), (2, 8, 2), (3, 1, 2)]):
        out = files.append(spark.createDataFrame(rows, "k int, v int, at int"), path, ["k"], score, "at", ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, 5, 1), (2, 8, 2), (3, 1, 2)]
    assert files.read_csv(spark, [f"{path}-none"], out.schema).count() == 0


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>A<th2></th><td> b <b>c</b></td></tr>\n<tr></tr></table>"), (2, None)], "id int, html string")
    assert [tuple(r) for r in files.html_rows(df, "id", "html").collect()] == [(1, 0, ["A", "b c"]), (1, 1, [])]


def test_leaking_names():
    assert quality.leaking(["ortg_l7_pre", "actual_margin", "final_score", "result_pre"]) == ["actual_margin", "final_score"]
