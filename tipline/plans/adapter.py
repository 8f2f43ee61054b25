"""The event table as team-game rows: two rows per game, with box-score figures derived from the ids. Every expression is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = {
    "game_id": "CAST(FLOOR(event_id / 2.0) AS BIGINT)",
    "home_away": "CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END",
    "team_id": "user_id",
    "game_dt": "ts",
    "points": "CAST(value AS DOUBLE)",
    "fga": "CAST(45 + event_id % 25 AS DOUBLE)",
    "fta": "CAST(8 + event_id % 17 AS DOUBLE)",
    "tov": "CAST(6 + event_id % 11 AS DOUBLE)",
    "orb": "CAST(4 + event_id % 13 AS DOUBLE)",
    "drb": "CAST(15 + event_id % 9 AS DOUBLE)",
    "fgm": "CAST(15 + event_id % 14 AS DOUBLE)",
    "tpm": "CAST(event_id % 8 AS DOUBLE)",
    "tpa": "CAST(event_id % 8 + event_id % 13 AS DOUBLE)",
    "gaps": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END",
    "weight": "CAST(event_id % 5 AS DOUBLE)",
}
RATED = {"poss": "fga + 0.44e0 * fta - orb + tov", "ortg": "100e0 * points / (fga + 0.44e0 * fta - orb + tov)"}

TG = f"""tg AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in RATED.items())} FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMNS.items())} FROM events))"""
#: One row per game: both sides, a margin, and a prediction and a line made of the game's number.
GAMES = f"""{TG}, g0 AS (SELECT h.game_id, h.game_dt, h.team_id AS home_id, a.team_id AS away_id, h.points AS h_points, a.points AS a_points, h.points - a.points AS margin,
  h.ortg AS h_ortg, a.ortg AS a_ortg, h.poss AS h_poss, a.poss AS a_poss FROM tg h JOIN tg a ON h.game_id = a.game_id WHERE h.home_away = 'home' AND a.home_away = 'away'),
games AS (SELECT *, 0.5e0 * margin + game_id % 7 - 3 AS pred, CAST(game_id % 13 - 6 AS DOUBLE) AS line, game_id % 100 / 100e0 AS conf,
  CASE WHEN game_id % 3 = 0 THEN CAST(100 + game_id % 200 AS DOUBLE) WHEN game_id % 11 = 0 THEN NULL ELSE CAST(-100 - game_id % 250 AS DOUBLE) END AS odds FROM g0)"""

ORDER = ["game_dt", "game_id", "home_away"]


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()]).selectExpr("*", *[f"{e} AS {n}" for n, e in RATED.items()])


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipline.operators.joins import home_away

    both = home_away(team_games(spark, sf_dir), "game_id", "home_away", ["game_dt", "team_id", "points", "ortg", "poss"])
    g = both.selectExpr("game_id", "h_game_dt AS game_dt", "h_team_id AS home_id", "a_team_id AS away_id", "h_points", "a_points", "h_points - a_points AS margin", "h_ortg", "a_ortg", "h_poss", "a_poss")
    return g.selectExpr(
        "*", "0.5e0 * margin + game_id % 7 - 3 AS pred", "CAST(game_id % 13 - 6 AS DOUBLE) AS line", "game_id % 100 / 100e0 AS conf",
        "CASE WHEN game_id % 3 = 0 THEN CAST(100 + game_id % 200 AS DOUBLE) WHEN game_id % 11 = 0 THEN NULL ELSE CAST(-100 - game_id % 250 AS DOUBLE) END AS odds",
    )
