"""Queries over feeds: nested JSON, catalogue checks, reports, flags, names and prices as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.functions import betting as O
from tipline.functions import columns as C
from tipline.functions import text as X
from tipline.operators import aggregates as A
from tipline.operators import quality as Q
from tipline.plans.registry import query
from tipline.sources import files, nested
from tipline.sources.scratch import new_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Competitions in the shapes that feeds send: prices as numbers, texts or objects under several names, no odds, and text that breaks off.
_ODDS = """CASE o_orderkey % 5
WHEN 0 THEN concat('{"odds":[{"provider":{"name":"', o_orderpriority, '"},"details":"d', o_orderkey, '","overUnder":"', 120 + o_orderkey % 60, '.5","spread":-', o_orderkey % 30, '.5,"homeTeamOdds":{"moneyLine":-', 100 + o_orderkey % 400, '},"awayOdds":{"moneyLine":0,"american":"', 100 + o_orderkey % 300, '"}},{"spread":1}]}')
WHEN 1 THEN concat('{"odds":[{"provider":{"name":"","id":', o_orderkey, '},"displayValue":"pick","spread":"even","homeMoneyline":"+', 100 + o_orderkey % 70, '","awayMoneyLine":', 110 + o_orderkey % 9, '.9}]}')
WHEN 2 THEN '{"odds":[]}' WHEN 3 THEN '{"odds":[{"spread":2.5}], "name'
ELSE concat('{"odds":[{"homeTeamOdds":{"moneyLine":"n/a"},"homeOdds":{"value":', 150 + o_orderkey % 50, '},"overUnder":', 130 + o_orderkey % 7, '}]}') END"""


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_orderkey AS VARCHAR) END AS odds_provider, CASE o_orderkey % 5 WHEN 0 THEN 'd' || o_orderkey WHEN 1 THEN 'pick' END AS odds_details,
CASE WHEN o_orderkey % 5 = 0 THEN -(o_orderkey % 30 + 0.5e0) END AS spread, CASE o_orderkey % 5 WHEN 0 THEN 120.5e0 + o_orderkey % 60 WHEN 4 THEN 130e0 + o_orderkey % 7 END AS over_under,
CASE o_orderkey % 5 WHEN 0 THEN -100 - o_orderkey % 400 WHEN 1 THEN 100 + o_orderkey % 70 WHEN 4 THEN 150 + o_orderkey % 50 END AS home_moneyline, CASE o_orderkey % 5 WHEN 0 THEN 100 + o_orderkey % 300 WHEN 1 THEN 110 + o_orderkey % 9 END AS away_moneyline FROM orders""")
def json_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_ODDS} AS payload")
    return feed.select("id", nested.odds(nested.parsed(F.col("payload"))).alias("o")).select("id", "o.*")


_STATS = """CASE o_orderkey % 4
WHEN 0 THEN concat('[{"name":"points","abbreviation":"PTS","displayValue":"', o_orderkey % 100, '"},{"label":"PTS","value":7},{"name":"fouls"}]')
WHEN 1 THEN concat('[{"labels":["points","fouls","left over"],"stats":["', o_orderkey % 100, '","', o_orderkey % 7, '"]}]')
WHEN 2 THEN concat('[{"labels":[],"keys":["points"],"stats":["', o_orderkey % 100, '","9"]},3,{"name":"fouls","value":', o_orderkey % 5, '}]')
ELSE '{"points":1}' END"""


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 100 AS VARCHAR) END AS points, CASE WHEN o_orderkey % 4 = 0 THEN '7' END AS pts, CASE o_orderkey % 4 WHEN 1 THEN CAST(o_orderkey % 7 AS VARCHAR) WHEN 2 THEN CAST(o_orderkey % 5 AS VARCHAR) END AS fouls FROM orders""")
def json_stat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_STATS} AS payload")
    stats = feed.select("id", nested.stat_map(nested.items(nested.parsed(F.col("payload")), ".")).alias("m"))
    return stats.select("id", *[F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("points", "PTS", "fouls")])


_INJURED = """CASE c_custkey % 4
WHEN 0 THEN concat('{"team":{"displayName":"', c_name, '","injuries":[{"athlete":{"id":', c_custkey, ',"displayName":"A","position":{"abbreviation":"G"}},"status":"Out","type":{"description":"Knee"},"details":{"side":"Left"},"longComment":"long"},{"status":"no athlete"}]}}')
WHEN 1 THEN concat('{"injuries":[{"athlete":{"id":"', c_custkey, '","shortName":"B","position":"F"},"type":"Illness","details":{"detail":"flu","returnDate":"2024-01-0', c_custkey % 9, '"},"shortComment":"s"}]}')
WHEN 2 THEN concat('{"team":{"name":"', c_name, '"},"athletes":[{"athlete":{"id":1,"fullName":"C"},"injuries":[{"status":"Doubtful"},{"status":"Out","athlete":{"id":2}}]},{"id":3,"injuries":[{"status":"Out"}]},{"injuries":"none"}]}')
ELSE 'not json' END"""


@query("""WITH i AS (SELECT c_custkey AS team_id, c_name AS team, CAST(c_custkey AS VARCHAR) AS athlete_id, 'A' AS player, 'G' AS position, 'Out' AS status, 'Knee' AS injury_type, 'long' AS detail, 'Left' AS side, '' AS return_date FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'Unknown', CAST(c_custkey AS VARCHAR), 'B', 'F', '', 'Illness', 'flu', '', '2024-01-0' || (c_custkey % 9) FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, c_name, a, p, '', s, '', '', '', '' FROM customer, (VALUES ('1', 'C', 'Doubtful'), ('2', 'Unknown', 'Out'), ('3', 'Unknown', 'Out')) v(a, p, s) WHERE c_custkey % 4 = 2) SELECT * FROM i""")
def json_injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS team_id", f"{_INJURED} AS payload")
    return feed.select("team_id", F.inline(nested.injuries(nested.parsed(F.col("payload")))))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 100")
def scan_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows in an order that decides every tie: a limit is what this scan is for."""
    return files.first_rows(_table(spark, sf_dir, "lineitem"), 100, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


_CHECKED = ("orders", "lineitem", "events")


@query(f"""WITH n AS ({' UNION ALL '.join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _CHECKED)} UNION ALL SELECT 'unused', 0 UNION ALL SELECT 'absent', NULL)
SELECT name, n_rows IS NOT NULL AS present, n_rows, CASE WHEN n_rows IS NULL THEN 'missing' WHEN name = 'unused' THEN 'empty, but orders has rows' WHEN n_rows = 0 THEN 'empty' ELSE 'ok' END AS status FROM n""")
def audit_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables there are, how many rows they have, and which are empty although the table that they come from is not."""
    tables = {t: _table(spark, sf_dir, t) for t in _CHECKED} | {"unused": _table(spark, sf_dir, "orders").where("false"), "absent": None}
    return Q.row_counts(spark, tables, {"unused": "orders"})


@query("SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice) + 3e-10, 4) + 0e0 AS mean FROM orders GROUP BY o_orderstatus")
def report_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON and as CSV, each in one file; what is returned was read back from both."""
    report = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), C.rounded(F.avg("o_totalprice"), 4).alias("mean"))
    at = new_dir(spark, "reports")
    for kind in ("json", "csv"):
        files.report(report, f"{at}/{kind}", kind)
    back = [files.read_report(spark, f"{at}/{kind}", kind, report.schema) for kind in ("json", "csv")]
    return back[0].join(back[1].select("status", "n", "mean"), ["status", "n", "mean"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS returned, true AS data_ok, l_linestatus = 'F' AS final FROM lineitem")
def clean_bool_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as true or false: unknown words are false, and so are missing values; a column that is not there is true."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", " True").otherwise("maybe").alias("returned"), F.when(F.col("l_linestatus") == "F", 1.0).alias("final"))
    return lines.select("l_orderkey", "l_linenumber", *[C.flag(lines, c).alias(c) for c in ("returned", "data_ok", "final")])


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(100 + p_partkey % 200 AS DOUBLE) WHEN 1 THEN CAST(-100 - p_partkey % 300 AS DOUBLE) WHEN 2 THEN 0e0 END AS odds FROM part),
i AS (SELECT p_partkey, CASE WHEN odds > 0 THEN 100 / (odds + 100) WHEN odds < 0 THEN -odds / (100 - odds) END AS x FROM p) SELECT p_partkey, round(x + 3e-10, 6) + 0e0 AS or_null, round(coalesce(x, 0) + 3e-10, 6) + 0e0 AS or_zero FROM i""")
def odds_error_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    odds = F.when(k % 4 == 0, (100 + k % 200).cast("double")).when(k % 4 == 1, (-100 - k % 300).cast("double")).when(k % 4 == 2, 0.0)
    return _table(spark, sf_dir, "part").select("p_partkey", C.rounded(O.implied(odds)).alias("or_null"), C.rounded(O.implied_or(odds, "zero")).alias("or_zero"))


_NAMES = ["UConn", " UNC ", "St. Johns", "Miami (FL)", "Texas A&M", "The Ohio State", "Penn", "N.C. State", "St.  Mary's", "Massachusetts-Lowell"]
_CLEAN = ["connecticut", "north carolina", "st john's", "miami florida", "texas aandm", "ohio state", "pennsylvania", "north carolina state", "st mary's", "massachusettslowell"]


def _pick(values: list[str]) -> str:
    return "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_pick(_CLEAN)} AS team_key FROM part")
def names_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team names as a key: spelling evened out, then the known aliases."""
    raw = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", X.team_key(raw).alias("team_key"))


@query(f"WITH l AS (SELECT p_partkey, {_pick(_CLEAN)} AS k FROM part), r AS (SELECT k, min(p_partkey) AS first FROM l GROUP BY k) SELECT l.p_partkey, r.first FROM l JOIN r ON l.k = r.k")
def join_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables joined by the keys of their differently spelled names."""
    raw, clean = (F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 10 + 1).cast("int")) for v in (_NAMES, _CLEAN))
    part = _table(spark, sf_dir, "part")
    right = part.select("p_partkey", X.team_key(clean).alias("k")).groupBy("k").agg(F.min("p_partkey").alias("first"))
    return part.select("p_partkey", X.team_key(raw).alias("k")).join(right, "k").select("p_partkey", "first")


@query()
def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profile from sketches kept by ship year: parts add up without the rows."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("part", F.year("l_shipdate"))
    return A.merged_profile(A.profile_parts(lines, ["l_partkey", "l_extendedprice", "l_returnflag"], ["part"]))


@query("""WITH e AS (SELECT event_type, value, props, event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN ' ' ELSE 'x' END AS note, CASE WHEN event_id % 10 = 0 THEN 'maybe' ELSE 'Yes' END AS is_late, CASE WHEN event_id % 5 < 3 THEN NULL ELSE event_id END AS rare FROM events)
SELECT 'missing_column' AS code, 'venue' AS "column", 1e0 AS value, 'error' AS severity UNION ALL SELECT 'high_null_rate', 'rare', round(avg(CASE WHEN rare IS NULL THEN 1e0 ELSE 0e0 END) + 3e-10, 6), 'warning' FROM e HAVING avg(CASE WHEN rare IS NULL THEN 1e0 ELSE 0e0 END) > 0.5
UNION ALL SELECT 'range_violation', 'value', round(max(value) + 3e-10, 6), 'warning' FROM e HAVING max(value) > 50 UNION ALL SELECT 'dtype_coerce_failed', 'is_late', round(avg(CASE WHEN is_late = 'Yes' THEN 1e0 ELSE 0e0 END) + 3e-10, 6), 'warning' FROM e HAVING avg(CASE WHEN is_late = 'Yes' THEN 1e0 ELSE 0e0 END) < 0.95
UNION ALL SELECT 'high_empty_string_rate', 'note', round(avg(CASE WHEN note = ' ' THEN 1e0 ELSE 0e0 END) + 3e-10, 6), 'warning' FROM e WHERE note IS NOT NULL HAVING avg(CASE WHEN note = ' ' THEN 1e0 ELSE 0e0 END) > 0.5
UNION ALL SELECT 'invalid_values', 'event_type', CAST(count(*) AS DOUBLE), 'error' FROM e WHERE event_type NOT IN ('view', 'click') HAVING count(*) > 0 UNION ALL SELECT 'duplicate_keys', 'event_type', CAST(count(*) - count(DISTINCT event_type) AS DOUBLE), 'error' FROM e""")
def dq_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against what its columns should hold."""
    i = F.col("event_id")
    df = _table(spark, sf_dir, "events").select(
        "event_type", "value", "props", "event_id", F.when(i % 3 == 1, " ").when(i % 3 == 2, "x").alias("note"), F.when(i % 10 == 0, "maybe").otherwise("Yes").alias("is_late"), F.when(i % 5 >= 3, i).alias("rare")
    )
    specs = [Q.Spec("venue", "text", required=True), Q.Spec("value", "number", low=-1e9, high=50.0), Q.Spec("props", "json"), Q.Spec("note", "text"), Q.Spec("is_late", "flag"), Q.Spec("rare", "number")]
    return Q.validate(df, specs, ["event_type"], {"event_type": ["view", "click"]}).withColumn("value", C.rounded(F.col("value")))
