"""Windows over entities cut into ranges equal the same windows over whole entities."""

import pytest
from pyspark.sql import functions as F

from tipline.operators import long_windows, windows
from tipline.plans.adapter import ORDER, team_games

ID = ["game_id", "home_away"]


def same(got, want, columns):
    """Equal rows, but for the last digits of floats: sums run in another order."""
    a, b = (sorted((tuple(r) for r in df.select(*ID, *columns).collect()), key=lambda r: r[:2]) for df in (got, want))
    assert [tuple(x is None for x in r) for r in a] == [tuple(x is None for x in r) for r in b]
    assert all(x == y or x == pytest.approx(y, rel=1e-9, abs=1e-9) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """All rows of one entity, those of a few, and some whose key is null."""
    df = team_games(spark, sf_dir).withColumn("group", F.when(F.col("team_id") % 5 == 0, None).when(F.col("team_id") < 6, "short").otherwise("long"))
    return df.withColumn("league", F.lit("all")).cache()


@pytest.mark.parametrize("most", [3, 40, 300])
@pytest.mark.parametrize("key", ["league", "group"])
def test_pack(rows, key, most):
    args = (["ortg", "gaps"], [key], ORDER, (3, 7), 7)
    got, want = long_windows.pack(rows, *args, most=most), windows.pack(rows, *args)
    assert sorted(got.columns) == sorted(want.columns)
    same(got, want, [c for c in want.columns if c.endswith("_pre")])


@pytest.mark.parametrize("most", [5, 60])
def test_other_frames(rows, most):
    def add(df, keys):
        df = windows.slope(df, "gaps", "slope", keys, ORDER, 7)
        df = windows.shift(df, "gaps", "shift", keys, ORDER, 7, 2)
        df = windows.weighted(df, "gaps", "weight", keys, ORDER, 7, "gaps")
        return windows.weighted_quantile(df, "gaps", "weight", "wq", keys, ORDER, 7, 0.8)

    got = long_windows.over_long(rows, ["group"], ORDER, 7, add, most)
    same(got, add(rows, ["group"]), ["slope", "shift", "gaps_wmean", "gaps_neff", "wq"])


def test_ranges_are_bounded_and_short_entities_stay_whole(rows):
    ranges = long_windows.Ranges(rows, ["group"], ORDER, 7, 100)
    counts = {k or "null": n for k, n in rows.groupBy("group").count().collect()}
    long = [n for n in counts.values() if n > 100]
    assert ranges.total == sum(long) and ranges.whole.count() == sum(counts.values()) - sum(long)
    cut = ranges.cut({})
    sizes = [r["count"] for r in cut.groupBy("group", "_range").count().collect()]
    assert len(sizes) >= ranges.total // 100 and max(sizes) <= 3 * 100 + 7
    assert cut.where("_own").count() == ranges.total


def test_nothing_is_cut_where_all_are_short(rows):
    assert long_windows.Ranges(rows, ["team_id"], ORDER, 7, 10_000).total == 0
    assert long_windows.over_long(rows.limit(0), ["team_id"], ORDER, 7, lambda df, keys: df.withColumn("x", F.lit(1)), 2).count() == 0
