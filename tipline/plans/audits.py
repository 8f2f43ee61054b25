"""Queries over gates, completions, audited merges and summaries of bets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipline.functions import betting as O
from tipline.functions import columns as C
from tipline.operators import audits as D
from tipline.operators import joins as J
from tipline.plans.adapter import GAMES, TG, games, team_games
from tipline.plans.registry import query

R = C.rounded


def _r(sql: str) -> str:
    return f"round({sql} + 3e-10, 6) + 0e0"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[R(F.col(c)).alias(c) for c in values])


#: Raw rows with the usual faults; the same text serves Spark and DuckDB.
_RAW = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE CAST(user_id AS {s}) END AS athlete_id, CASE event_id % 7 WHEN 0 THEN 'Away' WHEN 1 THEN 'home' WHEN 2 THEN NULL ELSE 'away' END AS side,
CASE WHEN event_id % 4 = 0 THEN 'soon' WHEN event_id % 4 = 1 THEN NULL ELSE '2024-01-02T03:04:05' END AS moment, CASE WHEN event_id % 3 = 0 THEN '2024-01-02T03:04:05' ELSE '2024-01-02' END AS day,
CASE event_id % 6 WHEN 0 THEN 'FINAL' WHEN 1 THEN 'Post' WHEN 2 THEN NULL ELSE 'live' END AS state, CASE event_id % 8 WHEN 0 THEN '12' WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE '7.5' END AS score, event_type AS source FROM {t}"""
_RAW_SQL = f"r AS ({_RAW.format(s='VARCHAR', t='events')})"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "events").createOrReplaceTempView("_tipline_events")
    return spark.sql(_RAW.format(s="STRING", t="_tipline_events"))


@query(f"""WITH {_RAW_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (side IS NOT NULL AND side NOT IN ('home', 'away')) AS bad, count(*) FILTER (try_cast(moment AS TIMESTAMP) IS NULL) AS times FROM r)
SELECT 'rows' AS "check", CAST(n AS DOUBLE) AS value, n > 0 AS ok FROM n UNION ALL SELECT 'missing_columns', 1e0, false UNION ALL SELECT 'bad_sides', CAST(bad AS DOUBLE), bad = 0 FROM n
UNION ALL SELECT 'bad_moments', {_r('times / n')}, times / n <= 0.1 FROM n""")
def gate_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.integrity(_raw(spark, sf_dir), ["event_id", "athlete_id", "team"], "side", "moment")
    return found.select("check", R(F.col("value")).alias("value"), "ok")


@query(f"""WITH {_RAW_SQL} SELECT 'event_id' AS "column", 0 AS nulls, 0 AS misfits UNION ALL SELECT 'athlete_id', count(*) FILTER (coalesce(trim(athlete_id), '') = ''), count(*) FILTER (trim(athlete_id) <> '' AND try_cast(athlete_id AS BIGINT) IS NULL) FROM r
UNION ALL SELECT 'score', 0, count(*) FILTER (trim(score) <> '' AND try_cast(score AS DOUBLE) IS NULL) FROM r""")
def gate_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.preflight(_raw(spark, sf_dir), ["event_id", "athlete_id"], {"athlete_id": "long", "score": "double"})


@query(f"""WITH {_RAW_SQL} SELECT event_id, CASE WHEN trim(coalesce(athlete_id, '')) <> '' THEN athlete_id ELSE 'missing:' || event_id || ':' || coalesce(side, '') END AS athlete_id, coalesce(side, 'unknown') AS side, 'v1' AS parse_version
FROM r WHERE trim(coalesce(state, '')) <> '' AND trim(coalesce(score, '')) <> ''""")
def required_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with all required values, made-up ids for missing ones, and defaults."""
    df = D.required(_raw(spark, sf_dir), ["event_id", "state", "score"])
    df = df.withColumn("athlete_id", D.made_up_id(F.col("athlete_id"), F.col("event_id"), F.col("side")))
    return D.defaults(df, {"side": F.lit("unknown"), "parse_version": F.lit("v1")}).select("event_id", "athlete_id", "side", "parse_version")


@query(f"""WITH {_RAW_SQL} SELECT event_id, CASE WHEN day LIKE '%T%' AND trim(coalesce(moment, '')) = '' THEN day ELSE moment END AS moment, split_part(day, 'T', 1) AS day, coalesce(lower(state) IN ('final', 'post', 'completed'), false) AS completed FROM r""")
def repair_slipped_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.split_moment(_raw(spark, sf_dir), "day", "moment")
    return df.select("event_id", "moment", "day", D.named(F.col("state"), ("final", "post", "completed")).alias("completed"))


_FIELDS = ("athlete_id", "side", "moment", "state")


@query(f"""WITH {_RAW_SQL}, c AS (SELECT source, avg((CASE WHEN athlete_id IS NULL THEN 0e0 ELSE 1e0 END + CASE WHEN side IS NULL THEN 0e0 ELSE 1e0 END + CASE WHEN moment IS NULL THEN 0e0 ELSE 1e0 END + CASE WHEN state IS NULL THEN 0e0 ELSE 1e0 END) / 4) AS c, count(*) AS n FROM r GROUP BY source)
SELECT source, {_r('c')} AS completeness, n, CASE WHEN c >= 0.8 THEN 'HIGH' WHEN c >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c UNION ALL SELECT 'no such source', NULL, 0, 'FAILED'""")
def completeness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.completeness_level(_raw(spark, sf_dir), "source", _FIELDS, ["no such source"])
    return found.select("source", R(F.col("completeness")).alias("completeness"), "n", "level")


@query("""WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) || '|late' AS finding, o_orderkey FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT * FROM f WHERE o_orderkey % 3 = 0)
SELECT sha256(CAST(o_orderkey AS VARCHAR) || '|late') AS id, o_orderkey, 'old' AS batch FROM o UNION ALL SELECT sha256(CAST(o_orderkey AS VARCHAR) || '|late'), o_orderkey, 'new' FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)""")
def dq_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with ids made of what they say, added twice over: each is there once."""
    found = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(D.audit_id(F.col("o_orderkey"), F.lit("late")).alias("id"), "o_orderkey")
    old = found.where("o_orderkey % 3 = 0").withColumn("batch", F.lit("old"))
    new = found.withColumn("batch", F.lit("new"))
    order = [F.col("o_orderkey"), F.col("batch")]
    return D.insert_absent(D.insert_absent(old, new.unionByName(new), "id", order), new, "id", order)


_ORPHANS = """WITH s AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS copy, l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) AS orphan FROM lineitem l),
f AS (SELECT *, CASE WHEN copy > 1 THEN 'duplicate' WHEN orphan THEN 'orphan' WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'pruned' END AS reason FROM s)"""


@query(f"""{_ORPHANS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, {_r('CAST(sum(l_quantity) AS DOUBLE)')} AS quantity FROM f GROUP BY 1""")
def delete_with_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates, orphans and old rows go to an audit with their reason; both outputs together are the whole table."""
    parts = _table(spark, sf_dir, "part").where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    df = _table(spark, sf_dir, "lineitem").withColumn("copy", copy).join(parts, "l_partkey", "left")
    kept, audit = D.delete_audited(df, {"duplicate": F.col("copy") > 1, "orphan": F.col("known").isNull(), "pruned": F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp")})
    both = audit.unionByName(kept.withColumn("reason", F.lit("kept")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), R(F.sum("l_quantity")).alias("quantity"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'),
o AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01')
SELECT l_orderkey, l_linenumber, 'staged' AS origin FROM s WHERE rn = 1 UNION ALL SELECT l_orderkey, l_linenumber, 'old' FROM o WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM s)""")
def merge_distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped from 1995 on, staged over the lines before."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    late = F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")
    old = lines.where(~late).select("l_orderkey", "l_linenumber").distinct().withColumn("origin", F.lit("old"))
    staged = lines.where(late).withColumn("origin", F.lit("staged"))
    return D.upsert_latest(old, staged, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey"])


@query(f"""WITH {GAMES}, l AS (SELECT game_id, line - 1 AS line, conf * 2 AS conf FROM games WHERE game_id % 4 <> 0) SELECT g.game_id, {_r('g.line')} AS line, {_r('l.line')} AS line_lines, {_r('l.conf')} AS conf_lines, {_r('g.pred + l.line')} AS edge FROM games g LEFT JOIN l USING (game_id)""")
def join_inferred_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with lines on the first key that both have; clashing columns carry a suffix."""
    g = games(spark, sf_dir)
    lines = g.where("game_id % 4 <> 0").selectExpr("game_id", "line - 1 AS line", "conf * 2 AS conf")
    both = D.with_suffixes(g, lines, ["event_id", "game_id", "external_game_id"], "_lines").withColumn("edge", F.col("pred") + F.col("line_lines"))
    return _rounded(both, ["game_id"], ["line", "line_lines", "conf_lines", "edge"])


@query(f"""WITH {GAMES}, l AS (SELECT game_id, line AS market FROM games WHERE game_id % 5 <> 0) SELECT game_id, {_r('pred')} AS pred, {_r('market')} AS market FROM games JOIN l USING (game_id)""")
def join_predictions_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir)
    return _rounded(g.select("game_id", "pred").join(g.where("game_id % 5 <> 0").select("game_id", F.col("line").alias("market")), "game_id"), ["game_id"], ["pred", "market"])


@query(f"""WITH {TG}, n AS (SELECT *, 'Team ' || team_id AS team FROM tg), a AS (SELECT p.game_id, p.home_away, 'TEAM ' || q.team_id AS wanted FROM n p JOIN n q ON p.game_id = q.game_id AND p.home_away <> q.home_away)
SELECT a.game_id, a.home_away, max(n.points) AS opp_points FROM a JOIN n ON n.game_id = a.game_id AND lower(n.team) = lower(a.wanted) GROUP BY a.game_id, a.home_away""")
def join_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opponent's row of the same event, by its name in any case."""
    n = team_games(spark, sf_dir).withColumn("team", F.concat(F.lit("Team "), F.col("team_id").cast("string")))
    asked = J.opponent(n, "game_id", "home_away", ["team_id"], [F.desc("game_dt")]).where("opp_join_ok").select("game_id", "home_away", F.lower(F.concat(F.lit("TEAM "), F.col("opp_team_id").cast("string"))).alias("name"))
    there = n.select("game_id", F.lower("team").alias("name"), "points").groupBy("game_id", "name").agg(F.max("points").alias("opp_points"))
    return asked.join(there, ["game_id", "name"]).select("game_id", "home_away", "opp_points")


@query(f"""WITH {GAMES}, t AS (SELECT DISTINCT team_id, 'Team ' || team_id % 40 AS name FROM tg), seasons AS (SELECT DISTINCT year(game_dt) AS season FROM tg)
SELECT g.game_id, s.season, h.name AS home_name, a.name AS away_name, c.n AS home_games FROM games g JOIN seasons s ON year(g.game_dt) = s.season JOIN t h ON h.team_id = g.home_id JOIN t a ON a.team_id = g.away_id
JOIN (SELECT team_id, count(*) AS n FROM tg WHERE home_away = 'home' GROUP BY team_id) c ON c.team_id = g.home_id""")
def join_multi_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with their season, both teams' names and the home team's number of home games."""
    tg, g = team_games(spark, sf_dir), games(spark, sf_dir).withColumn("season", F.year("game_dt"))
    teams = tg.groupBy("team_id").agg(F.count_if(F.col("home_away") == "home").alias("home_games")).withColumn("name", F.concat(F.lit("Team "), (F.col("team_id") % 40).cast("string")))
    seasons = tg.select(F.year("game_dt").alias("season")).distinct()
    home, away = (teams.select(F.col("team_id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("home_games").alias(f"{s}_games")) for s in ("home", "away"))
    return g.join(seasons, "season").join(home, "home_id").join(away, "away_id").select("game_id", "season", "home_name", "away_name", "home_games")


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS source_id, max(s_name) AS name, count(*) AS n FROM supplier WHERE s_name IS NOT NULL GROUP BY s_nationkey""")
def agg_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").where("s_name IS NOT NULL")
    return s.groupBy(F.col("s_nationkey").cast("string").alias("source_id")).agg(F.max("s_name").alias("name"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS order_shipped FROM lineitem")
def win_partition_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.max("l_shipdate").over(w).alias("order_shipped"))


_BETS = "bets AS (SELECT game_id, CASE game_id % 3 WHEN 0 THEN 'spread' WHEN 1 THEN 'total' ELSE 'ml' END AS market, CASE WHEN margin + line > 0 THEN 1e0 WHEN margin + line < 0 THEN 0e0 ELSE 0.5e0 END AS won FROM games), pl AS (SELECT *, CASE won WHEN 1 THEN 100 / 110e0 WHEN 0 THEN -1e0 ELSE 0e0 END AS pnl FROM bets)"


@query(f"""WITH {GAMES}, {_BETS} SELECT market, count(pnl) AS bets, {_r('avg(won)')} AS win_rate, {_r('sum(pnl)')} AS pnl, {_r('avg(pnl)')} AS avg_pnl FROM pl GROUP BY market""")
def agg_market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir)
    won = O.ats_result(F.col("margin"), F.col("line"), F.lit("home"))
    bets = g.select(F.when(F.col("game_id") % 3 == 0, "spread").when(F.col("game_id") % 3 == 1, "total").otherwise("ml").alias("market"), won.alias("won"), O.profit(won).alias("pnl"))
    return bets.groupBy("market").agg(F.count("pnl").alias("bets"), R(F.avg("won")).alias("win_rate"), R(F.sum("pnl")).alias("pnl"), R(F.avg("pnl")).alias("avg_pnl"))


@query(f"""WITH {GAMES}, v AS (SELECT round(pred, 0) AS value, count(*) AS n FROM games GROUP BY 1) SELECT value, n, (SELECT count(*) FROM v) AS kinds, (SELECT count(*) FROM v) <= 1 AS constant FROM v ORDER BY n DESC, value LIMIT 5""")
def value_counts_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest predictions, how many there are, and whether all are the same."""
    counts = games(spark, sf_dir).groupBy(F.round("pred", 0).alias("value")).agg(F.count("*").alias("n"))
    kinds = counts.count()
    return counts.orderBy(F.desc("n"), "value").limit(5).withColumns({"kinds": F.lit(kinds).cast("long"), "constant": F.lit(kinds <= 1)})


@query(f"""WITH {GAMES} SELECT {_r('avg(coalesce(line - pred, 0))')} AS clv, 0e0 AS roi FROM games""")
def clv_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.mean_or_zero(games(spark, sf_dir).withColumn("clv", F.col("line") - F.col("pred")), {"clv": "clv", "roi": "no_such_column"})
    return found.select(R(F.col("clv")).alias("clv"), "roi")


@query("""SELECT l_orderkey AS event_id, l_suppkey AS team_id, CAST(sum(coalesce(l_quantity, 0)) AS BIGINT) AS fgm, CAST(sum(l_linenumber) AS BIGINT) AS orb, count(*) AS players FROM lineitem GROUP BY 1, 2""")
def player_team_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("team_id")).agg(
        F.sum(F.coalesce("l_quantity", F.lit(0))).cast("long").alias("fgm"), F.sum("l_linenumber").cast("long").alias("orb"), F.count("*").alias("players")
    )


@query(f"""SELECT year(o_orderdate) AS season, {_r("avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END)")} AS completion_rate, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) >= 0.5 AS passes FROM orders GROUP BY 1""")
def completion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    return _table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("season")).agg(R(rate).alias("completion_rate"), (rate >= 0.5).alias("passes"))


_NEUTRAL = f"{TG}, n AS (SELECT *, game_id % 7 = 0 AS neutral, points - 50 AS margin FROM tg)"
_TEAMS = "t AS (SELECT team_id, count(*) FILTER (neutral) AS k, avg(margin) FILTER (neutral) AS neu, count(*) FILTER (home_away = 'home') AS nh, avg(margin) FILTER (home_away = 'home') AS home, count(*) FILTER (home_away = 'away') AS na, avg(margin) FILTER (home_away = 'away') AS away FROM n GROUP BY team_id), g AS (SELECT avg(margin) FILTER (neutral) AS neu FROM n), d AS (SELECT team_id, CASE WHEN nh >= 5 THEN home - CASE WHEN k >= 3 THEN t.neu ELSE g.neu END END AS lift, CASE WHEN na >= 5 THEN away - CASE WHEN k >= 3 THEN t.neu ELSE g.neu END END AS penalty FROM t, g)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's home lift and away penalty against its neutral games, or all teams' where it has few."""
    n = team_games(spark, sf_dir).withColumns({"neutral": F.col("game_id") % 7 == 0, "margin": F.col("points") - 50})
    everyone = n.agg(F.avg(F.when(F.col("neutral"), F.col("margin"))).alias("m")).first().m
    home, away = (F.when(F.col("home_away") == s, F.col("margin")) for s in ("home", "away"))
    t = n.groupBy("team_id").agg(F.count_if("neutral").alias("k"), F.avg(F.when(F.col("neutral"), F.col("margin"))).alias("own"), F.count(home).alias("nh"), F.avg(home).alias("home"), F.count(away).alias("na"), F.avg(away).alias("away"))
    base = F.when(F.col("k") >= 3, F.col("own")).otherwise(F.lit(everyone).cast("double"))
    return t.select("team_id", F.when(F.col("nh") >= 5, F.col("home") - base).alias("lift"), F.when(F.col("na") >= 5, F.col("away") - base).alias("penalty"))


@query(f"""WITH {_NEUTRAL}, {_TEAMS} SELECT {_r('CASE WHEN count(lift) > 20 THEN avg(lift) ELSE 2.7e0 END')} AS home_margin_lift, {_r('CASE WHEN count(penalty) > 20 THEN avg(penalty) ELSE -2e0 END')} AS away_margin_penalty FROM d""")
def home_edge_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over teams, where more than twenty have enough games; else the usual figures."""
    t = _sides(spark, sf_dir)
    return t.agg(*[R(F.when(F.count(c) > 20, F.avg(c)).otherwise(usual)).alias(out) for c, out, usual in (("lift", "home_margin_lift", 2.7), ("penalty", "away_margin_penalty", -2.0))])


@query(f"""WITH {GAMES}, n AS (SELECT *, game_id % 7 = 0 AS neutral, points - 50 AS margin FROM tg), {_TEAMS} SELECT game_id, {_r('coalesce(h.lift, 2.7e0) - coalesce(a.penalty, -2e0)')} AS net_edge FROM games JOIN d h ON h.team_id = home_id JOIN d a ON a.team_id = away_id""")
def matchup_home_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _sides(spark, sf_dir)
    home, away = t.select(F.col("team_id").alias("home_id"), F.coalesce("lift", F.lit(2.7)).alias("lift")), t.select(F.col("team_id").alias("away_id"), F.coalesce("penalty", F.lit(-2.0)).alias("penalty"))
    both = games(spark, sf_dir).join(home, "home_id").join(away, "away_id").withColumn("net_edge", F.col("lift") - F.col("penalty"))
    return _rounded(both, ["game_id"], ["net_edge"])


@query(f"""WITH {TG} SELECT team_id, count(gaps) AS n, {_r('CASE WHEN count(gaps) >= 2 THEN stddev_samp(gaps) END')} AS deviation, coalesce(count(gaps) >= 2 AND stddev_samp(gaps) > 28, false) AS dispersed FROM tg GROUP BY team_id""")
def dispersion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    deviation = F.when(F.count("gaps") >= 2, F.stddev_samp("gaps"))
    return team_games(spark, sf_dir).groupBy("team_id").agg(F.count("gaps").alias("n"), R(deviation).alias("deviation"), F.coalesce(deviation > 28, F.lit(False)).alias("dispersed"))


@query(f"""WITH {GAMES}, e AS (SELECT *, pred + line AS edge, conf AS c, conf - 0.5e0 AS ml FROM games)
SELECT game_id, CASE WHEN abs(edge) < 2 OR c < 0.6 THEN 0e0 WHEN abs(edge) >= 5 AND c >= 0.6e0 + 0.1e0 THEN 3e0 WHEN abs(edge) >= 3.5 AND c >= 0.6e0 + 0.05e0 THEN 2e0 ELSE 1e0 END AS units,
CASE WHEN abs(ml) < 0.03 OR c < 0.6 THEN 0e0 WHEN odds > 0 THEN CASE WHEN abs(ml) < 0.03e0 + 0.02e0 THEN 0.25e0 ELSE 0.5e0 END WHEN abs(ml) >= 0.03e0 + 0.02e0 AND c >= 0.6e0 + 0.03e0 THEN 2e0 ELSE 1e0 END AS ml_units,
{_r('1 / (1 + exp(-edge / 12))')} AS win_prob, {_r('ln(greatest(least(conf, 1 - 1e-6), 1e-6) / (1 - greatest(least(conf, 1 - 1e-6), 1e-6)))')} AS logit, {_r('6 * tanh(edge / 6)')} AS bounded FROM e""")
def value_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge, conf = F.col("pred") + F.col("line"), F.col("conf")
    return games(spark, sf_dir).select(
        "game_id", O.value_units(edge, conf).alias("units"), O.moneyline_units(conf - 0.5, conf, F.col("odds")).alias("ml_units"), R(O.logistic(edge, 12.0)).alias("win_prob"), R(O.logit(conf)).alias("logit"), R(O.bounded(edge, 6.0)).alias("bounded")
    )


@query(f"""WITH {GAMES}, e AS (SELECT game_id, h_points + a_points + pred - 100 AS total, conf AS p, odds AS h, -odds AS a FROM games),
v AS (SELECT *, 100 * (p * CASE WHEN h > 0 THEN h / 100 ELSE -100 / h END - (1 - p)) AS ev_h, 100 * ((1 - p) * CASE WHEN a > 0 THEN a / 100 ELSE -100 / a END - p) AS ev_a FROM e)
SELECT game_id, {_r('total')} AS total_edge, CASE WHEN total > 0 THEN 'BET_OVER' WHEN total < 0 THEN 'BET_UNDER' ELSE 'PASS' END AS total_rec, {_r('p - CASE WHEN h > 0 THEN 100 / (h + 100) ELSE -h / (100 - h) END')} AS ml_edge, {_r('ev_h')} AS home_ml_ev, {_r('ev_a')} AS away_ml_ev,
CASE WHEN ev_h > ev_a THEN 'BET_HOME_ML' WHEN ev_a > 0 THEN 'BET_AWAY_ML' ELSE 'PASS' END AS ml_rec FROM v""")
def total_moneyline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = O.total_edge(F.col("h_points") + F.col("a_points") + F.col("pred"), F.lit(100.0)) | O.moneyline_edge(F.col("conf"), F.col("odds"), -F.col("odds"))
    df = games(spark, sf_dir).withColumns(made)
    return df.select("game_id", *[R(F.col(c)).alias(c) if c.endswith(("edge", "ev")) else c for c in made])


@query(f"""WITH {GAMES} SELECT game_id, {_r('pred + line')} AS edge FROM games WHERE conf > 0.65 AND abs(pred + line) > 3""")
def contrarian_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir).withColumn("edge", F.col("pred") + F.col("line"))
    return _rounded(g.where((F.col("conf") > 0.65) & (F.abs("edge") > 3)), ["game_id"], ["edge"])


_NESTED = """'{"team": "' || event_type || '", "labels": ["FG", "REB", "AST"], "players": [{"name": "p' || user_id || '", "stats": ["' || event_id % 9 || '-10", "' || event_id % 7 || '"]}, {"name": "q", "stats": ["3-4", "1", "2", "9"]}]}'"""


@query("""WITH p AS (SELECT event_id, unnest([1, 2]) AS k, event_type AS team, user_id FROM events)
SELECT event_id, team, CASE k WHEN 1 THEN 'p' || user_id ELSE 'q' END AS player, CASE k WHEN 1 THEN event_id % 9 || '-10' ELSE '3-4' END AS fg, CASE k WHEN 1 THEN CAST(event_id % 7 AS VARCHAR) ELSE '1' END AS reb, CASE k WHEN 1 THEN NULL ELSE '2' END AS ast FROM p""")
def json_nested_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players out of nested JSON: labels meet values, cut to the shorter list, and are read under the first alias that is there."""
    schema = "team string, labels array<string>, players array<struct<name: string, stats: array<string>>>"
    box = _table(spark, sf_dir, "events").select("event_id", F.from_json(F.expr(_NESTED), schema).alias("j"))
    players = box.select("event_id", "j.team", "j.labels", F.explode("j.players").alias("p"))
    least = F.least(F.size("labels"), F.size("p.stats"))
    stats = F.map_from_arrays(F.slice("labels", F.lit(1), least), F.slice("p.stats", F.lit(1), least))

    def stat(*names: str):
        return F.coalesce(*[F.col("stats")[n] for n in names])

    return players.select("event_id", "team", F.col("p.name").alias("player"), stats.alias("stats")).select("event_id", "team", "player", stat("FGM-A", "FG").alias("fg"), stat("REB").alias("reb"), stat("A", "AST").alias("ast"))


@query("""WITH c AS (SELECT unnest(['a', 'b', 'c']) AS code, unnest([3, 1, 2]) AS weight) SELECT code, weight, count(o_orderkey) AS orders FROM c LEFT JOIN orders ON o_orderkey % 3 = weight - 1 GROUP BY code, weight""")
def literal_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.range(1).select(F.inline(F.arrays_zip(F.array(*map(F.lit, "abc")).alias("code"), F.array(F.lit(3), F.lit(1), F.lit(2)).alias("weight"))))
    orders = _table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 3 + 1).cast("int").alias("weight")).agg(F.count("*").alias("orders"))
    return codes.join(orders, "weight", "left").select("code", "weight", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IS NOT NULL")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).where("id IS NOT NULL").distinct().orderBy("id")


@query(f"""WITH {TG}, x AS (SELECT fga, fta, tov, points FROM tg), m AS (SELECT avg(fga) AS a, avg(fta) AS b, avg(points) AS y, CAST(count(*) AS DOUBLE) AS n FROM x),
s AS (SELECT sum((fga - a) * (fga - a)) + 1 AS saa, sum((fta - b) * (fta - b)) + 1 AS sbb, sum((fga - a) * (fta - b)) AS sab, sum((fga - a) * (points - y)) AS say, sum((fta - b) * (points - y)) AS sby FROM x, m),
w AS (SELECT abs((say * sbb - sby * sab) / (saa * sbb - sab * sab)) AS wa, abs((sby * saa - say * sab) / (saa * sbb - sab * sab)) AS wb FROM s) SELECT {_r('wa / (wa + wb)')} AS w1, {_r('wb / (wa + wb)')} AS w2 FROM w""")
def composite_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of two parts in a composite: the sizes of their ridge coefficients (constant unpenalised, penalty 1), from sums of fixed size."""
    df = team_games(spark, sf_dir)
    m = df.agg(*[F.avg(c).alias(c) for c in ("fga", "fta", "points")]).first()
    a, b, y = (F.col(c) - F.lit(m[c]) for c in ("fga", "fta", "points"))
    s = df.agg((F.sum(a * a) + 1).alias("aa"), (F.sum(b * b) + 1).alias("bb"), F.sum(a * b).alias("ab"), F.sum(a * y).alias("ay"), F.sum(b * y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    wa, wb = F.abs((F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det), F.abs((F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det)
    return s.select(R(wa / (wa + wb)).alias("w1"), R(wb / (wa + wb)).alias("w2"))


@query(f"""WITH {TG}, p AS (SELECT game_id, home_away, ortg AS ortg_pre, poss AS pace_pre, points AS points FROM tg) SELECT game_id, home_away, {_r('ortg_pre')} AS ortg_pre, {_r('pace_pre')} AS pace_pre FROM p""")
def suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = team_games(spark, sf_dir).select("game_id", "home_away", F.col("ortg").alias("ortg_pre"), F.col("poss").alias("pace_pre"), "points")
    return _rounded(df, ["game_id", "home_away"], D.ends_with(df.columns, ["_pre"]))


@query("""SELECT o_orderkey AS entity_id, o_orderstatus AS severity, CAST(NULL AS VARCHAR) AS reason, '{"o_custkey":' || o_custkey || '}' AS _extra FROM orders""")
def audit_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit table under other headers, brought to the fixed layout."""
    odd = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Entity Id"), F.col("o_orderstatus").alias("LEVEL"), "o_custkey")
    return D.reshaped(odd, {"entity_id": ["id"], "severity": ["level"], "reason": ["code"]})
