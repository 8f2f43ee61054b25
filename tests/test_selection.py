"""Exact quantiles by refined histograms, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipline.operators import models, selection, windows
from tipline.plans.adapter import ORDER, team_games


@pytest.mark.parametrize("bins", [64, 2048])
def test_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    draw = np.random.default_rng(1)
    n = 400
    columns = {
        "normal": draw.normal(size=n).tolist(), "huge": (draw.normal(size=n) * 10.0 ** draw.integers(-30, 300, n)).tolist(), "two": [0.0] * (n // 2) + [1e9] * (n // 2), "one": [5.0] * n,
        "gaps": [None if i % 3 else float(i) for i in range(n)], "odd": [float("nan"), float("inf"), -float("inf"), 7.0, 9.0] + [None] * (n - 5), "none": [None] * n, "few": [1.0, 2.0] + [None] * (n - 2),
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3)
    for q in (0.5, 0.0, 0.9) if bins > 64 else (0.5,):
        got = selection.quantiles(df, list(columns), q)
        for c, values in columns.items():
            kept = [x for x in values if x is not None and np.isfinite(x)]
            if kept:
                assert got[c] == pytest.approx(float(np.quantile(kept, q)), rel=1e-12)
            else:
                assert got[c] is None
    assert selection.quantiles(df.limit(0), ["one"]) == {"one": None}
    assert models.imputed(df.select("none", "gaps"), ["none", "gaps"])[1] == {"none": 0.0, "gaps": float(np.median([x for x in columns["gaps"] if x is not None]))}


def test_walk_forward_report_equals_separate_fits(spark):
    draw = np.random.default_rng(2)
    n = 300
    x = draw.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, 1]
    y = x @ [2.0, -0.5, 4.0] + draw.normal(size=n)
    rows = [(i, *[None if k == 1 and i % 4 == 0 else float(v) for k, v in enumerate(r)], 3.0, None if i % 50 == 7 else float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 3.0, 1.0)], "at long, a double, b double, c double, still double, y double").repartition(4)
    features = ["a", "b", "c", "still"]
    got = models.walk_forward_report(df, "at", features, "y", [0, 100, 200, 1000], penalty=0.5).collect()

    def fit(train, test, used):
        med = {f: np.median([r[k] for r in train if r[k] is not None]) for k, f in enumerate(features, 1)}
        make = lambda rs: np.array([[1.0, *[r[features.index(f) + 1] if r[features.index(f) + 1] is not None else med[f] for f in used]] for r in rs])
        a, b = make(train), make(test)
        keep = [0, *[k for k in range(1, a.shape[1]) if a[:, k].std() > 1e-6]]
        w = np.zeros(a.shape[1])
        w[keep] = np.linalg.solve(a[:, keep].T @ a[:, keep] + 0.5 * np.diag([0.0] + [1.0] * (len(keep) - 1)), a[:, keep].T @ np.array([r[5] for r in train]))
        return w, float(np.sqrt(np.mean((b @ w - np.array([r[5] for r in test])) ** 2))), a.std(0)

    whole = [r for r in rows if r[5] is not None]
    by = {(r.fold, r.feature): r for r in got}
    assert len(got) == 16 and {by[0, f].weight for f in features} == {None} and {by[3, f].rmse for f in features} == {None}
    for k, (low, high) in enumerate([(100, 200), (200, 1000)], 1):
        train, test = [r for r in whole if r[0] < low], [r for r in whole if low <= r[0] < high]
        w, error, spread = fit(train, test, features)
        for i, f in enumerate(features):
            r = by[k, f]
            assert (r.n_train, r.n_test) == (len(train), len(test))
            assert [r.weight, r.importance, r.rmse, r.rmse_without] == pytest.approx([w[1 + i], abs(w[1 + i]) * spread[1 + i], error, fit(train, test, [g for g in features if g != f])[1]], rel=1e-6, abs=1e-9)


def test_weighted_trend_by_hand(spark, sf_dir):
    df = windows.weighted_trend(team_games(spark, sf_dir), "gaps", "weight", ["team_id"], ORDER, 7, 2, "g")
    teams: dict = {}
    for r in df.orderBy(*ORDER).collect():
        teams.setdefault(r.team_id, []).append(r)
    for rows in teams.values():
        for at, r in enumerate(rows):
            kept = [(p.gaps, p.weight) for p in rows[max(0, at - 7) : at] if p.gaps is not None and p.weight > 0]
            n = len(kept)
            if n < 2:
                assert r.g_wslope is None and r.g_wshift is None
                continue
            v, w, t = np.array([k[0] for k in kept]), np.array([k[1] for k in kept]), np.arange(1.0, n + 1)
            gap = t - np.average(t, weights=w)
            early, late = (slice(n - 4, n - 2), slice(n - 2, n)) if n >= 4 else (slice(0, n // 2), slice(n // 2, n))
            assert r.g_wslope == pytest.approx(np.sum(w * gap * (v - np.average(v, weights=w))) / np.sum(w * gap * gap), abs=1e-9)
            assert r.g_wshift == pytest.approx(np.average(v[late], weights=w[late]) - np.average(v[early], weights=w[early]), abs=1e-9)


def test_three_in_six(spark):
    rows = [("a", f"2024-01-{d:02d} 12:00:00", k) for k, d in enumerate([1, 2, 7, 8, 8, 20])] + [("a", None, 9)]
    df = spark.createDataFrame(rows, "team string, at string, n int").withColumn("at", F.to_timestamp("at"))
    got = windows.rest(df, "at", ["team"], ["at", "n"]).where("at IS NOT NULL").orderBy("at", "n").collect()
    assert [r.three_in_six for r in got] == [0, 0, 1, 1, 1, 0]
