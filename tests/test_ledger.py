"""Runs that stop half way and are taken up again."""

import pytest
from pyspark.sql import functions as F

from tipline.operators.joins import merge_games, merge_report
from tipline.sources import files
from tipline.sources.ledger import Ledger


def work(todo):
    ok = (F.col("k") % 5 != 0) | (F.col("attempts") == 1)
    return todo.where("k % 11 <> 0").select("k", F.when(~ok, "later").alias("error"), F.when(ok, F.col("k") * 10).alias("v"))


def state(ledger):
    return sorted(map(tuple, ledger.entries().collect())), sorted(map(tuple, ledger.data().collect()))


def test_a_lost_run_changes_nothing(spark, tmp_path, monkeypatch):
    keys = spark.range(1, 40).toDF("k").union(spark.createDataFrame([(7,), (None,)], "k long"))
    whole = Ledger(spark, f"{tmp_path}/a", "k", most=2)
    while whole.run(keys, work):
        pass
    broken = Ledger(spark, f"{tmp_path}/b", "k", most=2)
    assert broken.run(keys, work, at_most=15) == 15
    before = state(broken)
    with monkeypatch.context() as m:
        m.setattr(files, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            broken.run(keys, work)  # both parts are written, none is named
    assert state(broken) == before
    while broken.run(keys, work, at_most=9):
        pass
    assert state(broken) == state(whole)
    entries = {r.k: (r.status, r.attempts, r.error) for r in whole.entries().collect()}
    assert len(entries) == 39 and entries[1] == ("done", 1, None) and entries[5] == ("done", 2, None) and entries[11] == ("failed", 2, "no result")
    assert whole.run(keys, work) == 0 and whole.data().count() == 36


def test_games_of_several_sources(spark):
    schema = "id string, p int, home string, away string, score int, venue string, spread double"
    rows = [
        ("g1", 1, "A", "B", 70, None, None), ("g1", 2, "b", "a", 71, "hall", 3.0), ("g1", 3, "A", "B", 71, "hall", 4.0),
        ("g2", 1, "A", "B", 50, "x", 1.0), ("g2", 2, "C", "D", 60, "y", 2.0), ("g2", 3, "c", "d", 61, "y", 2.0),
        ("g3", 1, "A", "B", 1, "x", None), ("g3", 2, "A", "B", 2, "y", None), ("g4", 2, "E", "F", None, None, None),
    ]
    got = {r.key: r for r in merge_games(spark.createDataFrame(rows, schema), "id", ("home", "away"), "p", ["score", "venue"], ["spread", "venue"]).collect()}
    assert set(got) == {"g1", "g2", "g2_C_D", "g2_c_d", "g3", "g4"}
    assert (got["g1"].score, got["g1"].venue, got["g1"].spread, [c.field for c in got["g1"].conflicts]) == (71, "hall", 3.0, ["score"])
    assert (got["g3"].score, got["g3"].venue, got["g3"].n_sources) == (1, "x", 2)  # a tie: the better source
    assert got["g1"].conflicts[0]["values"] == ["70", "71", "71"] and (got["g4"].score, got["g4"].conflicts) == (None, [])
    report = merge_report(merge_games(spark.createDataFrame(rows, schema), "id", ("home", "away"), "p", ["score", "venue"], ["spread"])).first()
    assert tuple(report)[:4] == (6, 4, 2, 3) and report.conflicts_by_field == {"score": 2, "venue": 1}
