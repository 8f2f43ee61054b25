"""Operators whose edge cases the catalogue's tables do not show, on small fixtures with results worked out by hand."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tipline.functions import columns as C
from tipline.operators import audits as D
from tipline.operators import matchups as M
from tipline.operators import quality as Q
from tipline.operators import rules as U
from tipline.operators import windows as W
from tipline.sources import files


def test_the_rest_works_without_the_training_data_subpackage(tmp_path):
    """A copy without both folders imports, registers the event queries and leaves the pipeline out."""
    root = Path(__file__).resolve().parents[1]
    for name in ("tipline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tipline/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_expected_margin' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_table_is_replaced_by_a_pointer(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert files.table(spark, path) is None
    for k in range(4):
        old = files.table(spark, path, spark.range(1).schema)
        files.replace(old.unionByName(spark.range(k, k + 1)), path)
        assert sorted(r.id for r in files.table(spark, path).collect()) == list(range(k + 1))
    assert len([n for n in os.listdir(tmp_path / "t") if n.startswith("v-")]) == 2


def test_archive_and_page_check(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-31"), (2, "2024-02-01")], "id int, day string")
    files.archive(df, f"{tmp_path}/a", "day", "feed")
    back = spark.read.json(f"{tmp_path}/a")
    assert {(r.data.id, r.year, r.month, r.source, r.n_fields) for r in back.collect()} == {(1, 2024, 1, "feed", 2), (2, 2024, 2, "feed", 2)}
    (tmp_path / "page.csv").write_text("\n <!DOCTYPE html><html>wait</html>")
    (tmp_path / "data.csv").write_text("a,b\n1,2")
    (tmp_path / "none.csv").write_text("")
    assert [files.not_html(spark, f"{tmp_path}/{n}.csv") for n in ("page", "data", "none")] == [False, True, False]


def test_files_and_names(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "j/b.json").write_text('{"a": 3}')
    assert sorted(r.a for r in files.read_json_folder(spark, f"{tmp_path}/j", "a int").collect()) == [1, 2, 3]
    assert files.ddl(spark.createDataFrame([], "game_id long, x string").schema, "t") == 'CREATE TABLE "t" ("game_id" bigint, "x" string, PRIMARY KEY ("game_id"))'
    assert C.clean_name(" FG% Made ") == "fgpct_made"


def test_empty_days_of_a_calendar(spark):
    df = spark.sql("SELECT date'2024-02-28' AS d UNION ALL SELECT date'2024-03-01' UNION ALL SELECT date'2024-03-01'")
    assert sorted((str(r.day), r.n, r.status) for r in Q.calendar(df, "d").collect()) == [("2024-02-28", 1, "success"), ("2024-02-29", 0, "empty"), ("2024-03-01", 2, "success")]


@pytest.mark.parametrize(("text", "want"), [("5-10", (5, 10)), ("3/7", (3, 7)), ("5-x", (5, 0)), ("y/8", (0, 8)), ("--", (0, 0)), ("4", (0, 0)), ("", (0, 0)), (None, (0, 0))])
def test_made_and_attempted(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "s string").select(C.made_attempt(F.col("s")).alias("m")).first().m) == want


def test_first_column_with_a_value(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, None, 3)], "a int, b int, c int")
    assert [r[0] for r in df.select(C.first_present(df, ["x", "a", "b", "c"])).collect()] == [1, None]
    assert df.select(C.first_present(df, ["x"])).first()[0] is None


def test_required_defaults_and_ids(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " ", "s"), (3, None, "")], "k int, name string, source string")
    assert [r.k for r in D.required(df, ["k", "name"]).collect()] == [1] and D.required(df, ["k", "absent"]).count() == 0
    assert [r.source for r in D.defaults(df, {"source": F.lit("feed"), "version": F.lit("1")}).orderBy("k").collect()] == ["feed", "s", "feed"]
    assert [r.i for r in df.select(D.made_up_id(F.col("name"), F.col("k"), F.col("source")).alias("i")).collect()] == ["a", "missing:2:s", "missing:3:"]


def test_gates_on_an_empty_table(spark):
    df = spark.createDataFrame([], "event_id long, side string, moment string")
    assert {r.check: r.ok for r in D.integrity(df, ["event_id"], "side", "moment").collect()} == {"rows": False, "missing_columns": True, "bad_sides": True, "bad_moments": True}
    assert [tuple(r) for r in D.preflight(df, ["event_id"], {"side": "int"}).collect()] == [("event_id", 0, 0), ("side", 0, 0)]


def test_box_of_a_game_without_figures(spark):
    df = spark.createDataFrame([(36.0, 0.0), (None, None), (80.0, 60.0)], "points double, fga double")
    got = [r.fga for r in df.withColumns(M.completed_box(F.col("points"), {"fga": F.col("fga")})).collect()]
    assert got == [31.0, 62.0, 60.0]


def test_feature_matrix_guards(spark):
    rows = [(g, s, float(g + k), float(g * k), 1.0) for g in range(4) for k, s in enumerate(("home", "away"))] + [(9, "home", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "game long, side string, a_pre double, margin double, flat_pre double")
    matrix, names = M.feature_matrix(df, "game", "side", ["a_pre", "flat_pre", "margin"], F.col("h_margin") - F.col("a_margin"), ["margin"])
    assert names == ["h_a_pre", "a_a_pre"] and matrix.count() == 4  # the difference does not vary, nor does flat_pre
    with pytest.raises(ValueError, match="result"):
        M.feature_matrix(df, "game", "side", ["final_score_pre"], F.lit(1.0))


def test_curves_of_decay():
    assert W.decay("smooth") == (1.0, 0.98, 0.96, 0.94, 0.92, 0.7, 0.65, 0.6, 0.55, 0.5)
    assert W.decay("plateau") == (1.0, 1.0, 1.0, 1.0, 0.9, 0.5, 0.5, 0.5, 0.5, 0.5)
    assert W.decay("simple") == (1.0,) * 5 + (0.5,) * 5


def test_an_underdog_without_figures(spark):
    df = spark.createDataFrame([(7.0, "NCAA_R64")], "spread double, round string").withColumns({c: F.lit(None).cast("double") for c in _inputs()})
    r = df.select(*[c.alias(n) for n, c in U.upset(df, F.col("spread"), F.col("round")).items()]).first()
    # Only the rebounding part has a value: 0.05 / 0.15, weighted 0.9 of 9.9 in all.
    score = 0.9 / 3 / 9.9
    assert math.isclose(r.dog_dna_score, score) and math.isclose(r.upset_probability, (0.15 + 0.105) * (0.75 + score)) and r.upset_archetype_label == "LONGSHOT_DOG" and r.key_upset_drivers == [] and not r.upset_probability_cap_triggered


def _inputs():
    dog = "off_eff_rank def_eff_rank pace_rank ft_rate three_pt_def_rank off_reb_rate steal_rate_rank forced_to_rate_rank players_10plus_tourney_minutes_positive_pm high_volume_38pct_3pt_shooters coach_dog_ats_score seed kenpom_equivalent_seed auto_bid"
    fav = "pace_rank opp_ft_rate_allowed three_pt_off_rank def_reb_rate seed power_program_flag"
    return [f"dog_{n}" for n in dog.split()] + [f"fav_{n}" for n in fav.split()]
