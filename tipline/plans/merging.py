"""Queries that join, deduplicate, merge and check tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.functions import columns as C
from tipline.operators import joins as J
from tipline.operators import quality as Q
from tipline.plans.adapter import GAMES, ORDER, TG, games, team_games
from tipline.plans.registry import query
from tipline.sources import files
from tipline.sources.ledger import Ledger
from tipline.sources.manifest import Table
from tipline.sources.scratch import new_dir
from tipline.streaming import merge as S
from tipline.streaming.trailing import trailing_counts

R = C.rounded
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_TIE = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_TIE = ", ".join(LINE_TIE)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""WITH {TG} SELECT a.game_id, a.home_away, b.team_id AS opp_team_id, b.points AS opp_points, b.game_id IS NOT NULL AS opp_join_ok FROM tg a LEFT JOIN tg b ON a.game_id = b.game_id AND a.home_away <> b.home_away""")
def join_opponent_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.opponent(team_games(spark, sf_dir), "game_id", "home_away", ["team_id", "points"], [F.desc("game_dt")]).select("game_id", "home_away", "opp_team_id", "opp_points", "opp_join_ok")


@query(f"WITH {GAMES} SELECT game_id, home_id, away_id, h_points, a_points, {'round(margin + 3e-10, 6) + 0e0'} AS margin FROM games")
def join_home_away_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).select("game_id", "home_id", "away_id", "h_points", "a_points", R(F.col("margin")).alias("margin"))


@query(f"WITH {TG} SELECT a.game_id, a.team_id, b.team_id AS opp_team_id FROM tg a JOIN tg b ON a.game_id = b.game_id AND a.team_id <> b.team_id")
def join_opponent_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tg = team_games(spark, sf_dir).select("game_id", "team_id")
    return tg.join(tg.withColumnRenamed("team_id", "opp_team_id"), "game_id").where("team_id <> opp_team_id")


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def join_left_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return _table(spark, sf_dir, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_totalprice", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_semi_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return _table(spark, sf_dir, "part").join(ids, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def audit_missing_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one side that have no partner on the other."""
    large = _table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").join(large, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem) WHERE k = 2")
def group_exactly_two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.two_rows_each(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 540 DAY)""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when final rows of more than 540 days ago go; the cut is a constant, so that it reaches the scan."""
    return _table(spark, sf_dir, "orders").where("NOT (o_orderstatus = 'F' AND o_orderdate < timestamp'1998-08-02' - interval 540 days)").select("o_orderkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END DESC, {_TIE}) = 1")
def dedupe_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").withColumns({"returned": F.col("l_returnflag") == "R", "final": F.col("l_linestatus") == "F"})
    score = J.completeness(LINE_TIE, {"returned": 2.0, "final": 2.0}, "l_shipdate")
    return J.pick(df.withColumn("_score", score), LINE_KEYS, [F.desc("_score"), *map(F.col, LINE_TIE)]).select(*LINE_KEYS, "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pick(_table(spark, sf_dir, "lineitem"), LINE_KEYS, [F.desc(c) for c in LINE_TIE[:3]]).select(*LINE_KEYS, "l_partkey")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END DESC, l_shipdate DESC, {_TIE}) = 1""")
def merge_append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    old, new = df.where("l_partkey % 2 = 0"), df.where("l_partkey % 2 = 1")
    return J.append_best(old, new, LINE_KEYS, F.when(F.col("l_quantity") > 25, 1).otherwise(0), "l_shipdate", LINE_TIE).select(*LINE_KEYS, "l_partkey")


_OLD, _NEW = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"


@query(f"SELECT COALESCE(n.c_custkey, o.c_custkey) AS c_custkey, COALESCE(n.c_name, o.c_name) AS c_name, round(COALESCE(n.c_acctbal, o.c_acctbal) + 3e-10, 6) + 0e0 AS c_acctbal FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey")
def merge_upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END AS c_name", "CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal")
    return J.upsert(old, new, ["c_custkey"]).withColumn("c_acctbal", R(F.col("c_acctbal")))


@query(f"""WITH l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {_TIE}) = 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM l""")
def merge_copy_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines merged year by year into a table of which each merge rewrites only the files that may hold its keys; the latest line of a key stays."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    table = Table(spark, new_dir(spark, "lines"), LINE_KEYS, bucket_rows=20_000)
    for year in sorted(r.year for r in lines.select("year").distinct().collect()):  # a few, whatever the table's size
        table.append(lines.where(F.col("year").eqNullSafe(F.lit(year))).drop("year"), F.lit(0), "l_shipdate", LINE_TIE)
    return table.read().select(*LINE_KEYS, "l_partkey", "l_quantity")


@query("""SELECT c.c_custkey, o.o_orderkey AS asof_o_orderkey, o.o_totalprice AS asof_o_totalprice FROM (SELECT c_custkey, TIMESTAMP '1995-01-01' + INTERVAL (c_custkey % 900) DAY AS t FROM customer) c
LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey AND o_orderdate < c.t ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""")
def asof_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.expr("timestamp'1995-01-01' + make_dt_interval(cast(c_custkey % 900 as int))").alias("t"))
    orders = _table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey"))
    return J.asof(asked, orders, "key", "t", "o_orderdate", ["o_orderkey", "o_totalprice"], ["o_orderkey"]).select(F.col("key").alias("c_custkey"), "asof_o_orderkey", "asof_o_totalprice")


@query(f"""WITH {TG}, k AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away) AS rn FROM tg) SELECT a.game_id, a.home_away, count(b.game_id) AS n_before, COALESCE(string_agg(CAST(b.game_id AS VARCHAR), '|' ORDER BY b.rn), '') AS earlier, round(avg(b.points) + 3e-10, 6) + 0e0 AS avg_points
FROM k a LEFT JOIN k b ON a.team_id = b.team_id AND b.rn BETWEEN a.rn - 5 AND a.rn - 1 GROUP BY a.game_id, a.home_away""")
def asof_top5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = J.history(team_games(spark, sf_dir), ["team_id"], ORDER, ["game_id", "points"], 5, "h")
    total = F.aggregate("h", F.lit(0.0), lambda s, x: s + x["points"])
    return df.select("game_id", "home_away", F.size("h").cast("long").alias("n_before"), F.array_join(F.transform("h", lambda x: x["game_id"].cast("string")), "|").alias("earlier"), R(F.when(F.size("h") > 0, total / F.size("h"))).alias("avg_points"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1")
def latest_snapshot_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest(_table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query()
def join_fuzzy_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_name")
    return J.closest_names(part.select(F.concat("p_name", F.lit("s")).alias("p_name")), part, "p_name", 0.9)


_SOURCES = """SELECT o_orderkey AS game_id, 1 AS priority, o_orderstatus AS status, CAST(o_orderkey % 7 AS VARCHAR{n}) AS score FROM {t} UNION ALL
SELECT o_orderkey, 2, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END, CAST(o_orderkey % 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR{n}) FROM {t} UNION ALL
SELECT o_orderkey, 3, CASE WHEN o_orderkey % 8 = 0 THEN 'X' WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey % 7 + 1 AS VARCHAR{n}) END FROM {t} WHERE o_orderkey % 6 <> 1"""


@query(f"""WITH s AS ({_SOURCES.format(n='', t='orders')}), v AS (SELECT game_id, 'status' AS f, status AS x, count(*) AS n, min(priority) AS p FROM s WHERE status IS NOT NULL GROUP BY ALL UNION ALL SELECT game_id, 'score', score, count(*), min(priority) FROM s WHERE score IS NOT NULL GROUP BY ALL),
w AS (SELECT game_id, f, x, count(*) OVER (PARTITION BY game_id, f) AS kinds, row_number() OVER (PARTITION BY game_id, f ORDER BY n DESC, p, x) AS rn FROM v),
c AS (SELECT game_id, count(*) AS n_sources FROM s GROUP BY game_id)
SELECT c.game_id, n_sources, max(CASE WHEN f = 'status' THEN x END) AS status, max(CASE WHEN f = 'score' THEN x END) AS score, count(CASE WHEN kinds > 1 THEN 1 END) AS n_conflicts FROM c LEFT JOIN w ON c.game_id = w.game_id AND rn = 1 GROUP BY ALL""")
def multi_source_conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_SOURCES.format(n="(20)", t="{orders}"), orders=_table(spark, sf_dir, "orders"))
    return J.merge_sources(rows, ["game_id"], ["status", "score"], "priority")


#: Games of three sources: the second gives other scores and now and then other teams under the same id, the third turns the sides and leaves fields out.
_GAMES3 = """SELECT o_orderkey AS game_id, 1 AS priority, concat('T', o_custkey) AS home, 'Away' AS away, o_orderkey % 90 AS home_score, CASE WHEN o_orderkey % 4 <> 0 THEN 'hall' END AS venue, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS spread FROM {t} UNION ALL
SELECT o_orderkey, 2, CASE WHEN o_orderkey % 10 = 0 THEN 'Other' ELSE concat('t', o_custkey) END, 'AWAY', o_orderkey % 90 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END, CASE WHEN o_orderkey % 8 = 0 THEN 'arena' END, CASE WHEN o_orderkey % 2 = 0 THEN 2.5e0 END FROM {t} UNION ALL
SELECT o_orderkey, 3, 'away', concat('T', o_custkey), CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 90 + CASE WHEN o_orderkey % 15 = 0 THEN 1 ELSE 0 END END, 'dome', 7e0 FROM {t} WHERE o_orderkey % 6 <> 1"""


@query(f"""WITH s AS ({_GAMES3.format(t='orders')}), k AS MATERIALIZED (SELECT *, CASE WHEN priority = 2 AND game_id % 10 = 0 THEN concat_ws('_', game_id, home, away) ELSE CAST(game_id AS VARCHAR) END AS key FROM s),
a AS MATERIALIZED (SELECT key, count(*) AS n_sources, min_by(venue, priority) FILTER (venue IS NOT NULL) AS venue_any, min_by(spread, priority) FILTER (spread IS NOT NULL) AS spread, count(DISTINCT home_score) AS kinds, count(DISTINCT venue) AS venues, min(priority) AS best FROM k GROUP BY key),
v AS MATERIALIZED (SELECT key, home_score, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(priority)) AS rn FROM k WHERE home_score IS NOT NULL GROUP BY key, home_score),
w AS MATERIALIZED (SELECT key, venue, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(priority)) AS rn FROM k WHERE venue IS NOT NULL GROUP BY key, venue)
SELECT a.key, n_sources, CASE WHEN kinds > 1 THEN v.home_score ELSE b.home_score END AS home_score, CASE WHEN venues > 1 THEN w.venue ELSE coalesce(b.venue, venue_any) END AS venue, a.spread,
concat_ws('|', CASE WHEN kinds > 1 THEN 'home_score' END, CASE WHEN venues > 1 THEN 'venue' END) AS conflicts FROM a JOIN k b ON a.key = b.key AND a.best = b.priority LEFT JOIN v ON a.key = v.key AND v.rn = 1 LEFT JOIN w ON a.key = w.key AND w.rn = 1""")
def multi_source_game_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_GAMES3.format(t="{orders}"), orders=_table(spark, sf_dir, "orders"))
    merged = J.merge_games(rows, "game_id", ("home", "away"), "priority", ["home_score", "venue"], ["spread", "venue"])
    return merged.select("key", "n_sources", "home_score", "venue", "spread", F.array_join("conflicts.field", "|").alias("conflicts"))


@query("SELECT a.n_nationkey AS nation_a, b.n_nationkey AS nation_b, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1e0 WHEN a.n_regionkey = b.n_regionkey THEN 0.6e0 ELSE 0.05e0 END AS correlation FROM nation a, nation b")
def cross_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assumed correlation of every two members of the nations' table, which has 25 rows at any scale: the matrix is the result."""
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    everyone = nation.agg(F.collect_list(F.struct("n_nationkey", "n_regionkey")).alias("all"))
    pairs = everyone.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    same, near = F.col("a.n_nationkey") == F.col("b.n_nationkey"), F.col("a.n_regionkey") == F.col("b.n_regionkey")
    return pairs.select(F.col("a.n_nationkey").alias("nation_a"), F.col("b.n_nationkey").alias("nation_b"), F.when(same, 1.0).when(near, 0.6).otherwise(0.05).alias("correlation"))


@query(f"WITH {TG} SELECT game_id, home_away, CASE WHEN gaps IS NULL AND points < 0 THEN 'gaps|low' WHEN gaps IS NULL THEN 'gaps' ELSE 'low' END AS missing_fields FROM (SELECT *, CASE WHEN team_id % 4 = 0 THEN NULL ELSE 1 END AS low FROM tg) WHERE gaps IS NULL AND low IS NOT NULL")
def dq_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = team_games(spark, sf_dir).withColumn("low", F.when(F.col("team_id") % 4 != 0, 1))
    return Q.issues(df, F.lit(True), ["low"], ["gaps"]).select("game_id", "home_away", "missing_fields")


@query(f"WITH {TG} SELECT game_id, home_away, round(COALESCE(gaps, ortg * poss / 100) + 3e-10, 6) + 0e0 AS gaps FROM tg")
def dq_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, _ = Q.repair(team_games(spark, sf_dir), {"gaps": F.col("ortg") * F.col("poss") / 100})
    return whole.select("game_id", "home_away", R(F.col("gaps")).alias("gaps"))


@query(f"WITH {TG} SELECT game_id, home_away, 'gaps' AS repaired_field FROM tg WHERE gaps IS NULL")
def dq_repair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, audit = Q.repair(team_games(spark, sf_dir), {"gaps": F.col("ortg") * F.col("poss") / 100})
    return audit.select("game_id", "home_away", "repaired_field")


@query(f"""WITH {TG} SELECT game_id, home_away, CASE WHEN gaps IS NULL THEN 'rejected' WHEN poss > 85 OR weight = 0 THEN 'partial' ELSE 'verified' END AS status,
concat_ws('|', CASE WHEN gaps IS NULL THEN 'no_score' END, CASE WHEN poss > 85 THEN 'pace' END, CASE WHEN weight = 0 THEN 'no_weight' END) AS reasons FROM tg""")
def dq_status_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = Q.reasons({"no_score": F.col("gaps").isNull(), "pace": F.col("poss") > 85, "no_weight": F.col("weight") == 0})
    status = F.when(F.array_contains("tags", "no_score"), "rejected").when(F.size("tags") > 0, "partial").otherwise("verified")
    return team_games(spark, sf_dir).withColumn("tags", tags).select("game_id", "home_away", status.alias("status"), F.array_join("tags", "|").alias("reasons"))


@query(f"""WITH {TG}, x AS (SELECT 'null_rate' AS "check", 'gaps' AS "column", avg(CASE WHEN gaps IS NULL THEN 1e0 ELSE 0e0 END) AS value FROM tg UNION ALL SELECT 'null_rate', 'points', avg(CASE WHEN points IS NULL THEN 1e0 ELSE 0e0 END) FROM tg
UNION ALL SELECT 'out_of_range', 'poss', CAST(count(CASE WHEN poss < 50 OR poss > 80 THEN 1 END) AS DOUBLE) FROM tg UNION ALL SELECT 'duplicate_keys', 'team_id', CAST(count(*) AS DOUBLE) FROM (SELECT team_id FROM tg GROUP BY team_id HAVING count(*) > 1)
UNION ALL SELECT 'missing_column', 'venue', 1e0) SELECT "check", "column", round(value + 3e-10, 6) + 0e0 AS value, CASE WHEN "check" IN ('duplicate_keys', 'missing_column') AND value > 0 THEN 'error' WHEN "check" = 'out_of_range' AND value > 0 OR "check" = 'null_rate' AND value > 0.5 THEN 'warning' ELSE 'ok' END AS level FROM x""")
def dq_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.report(team_games(spark, sf_dir), ["gaps", "points", "venue"], {"poss": (50.0, 80.0)}, ["team_id"]).withColumn("value", R(F.col("value")))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT strftime(c.day, '%Y-%m-%d') AS day, COALESCE(n, 0) AS n, CASE WHEN n > 0 THEN 'success' ELSE 'empty' END AS status FROM c LEFT JOIN d ON c.day = d.day""")
def dq_calendar_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    return Q.calendar(orders, "d").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT n_regionkey AS page_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row, CAST(n_nationkey AS VARCHAR) || '|' || n_name AS cells FROM nation""")
def html_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables in pages: one page for each region, with a table of its nations."""
    cells = F.concat(F.lit("<tr class=x><td>"), F.col("n_nationkey").cast("string"), F.lit(" </td>\n<TD><b>"), F.col("n_name"), F.lit("</b></TD></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("cells")))), lambda r: r["cells"]), "\n")
    pages = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("page_id")).agg(F.concat(F.lit("<html><table>"), rows, F.lit("</table></html>")).alias("html"))
    return files.html_rows(pages, "page_id", "html").select("page_id", "row", F.array_join("cells", "|").alias("cells"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")


def _shared(spark: SparkSession) -> str:
    return new_dir(spark, "stream")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def stream_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's rows merged into a table, batch by batch; the latest row of each user stays."""
    at = _shared(spark)
    S.merge_stream(_stream(spark, sf_dir), f"{at}/table", f"{at}/checkpoint", ["user_id"], F.lit(1), "ts", ["event_id"]).awaitTermination()
    return Table(spark, f"{at}/table", ["user_id"]).read().select("user_id", "event_id", "value")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _shared(spark)

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/counts/batch={batch}")

    counts = S.window_counts(_stream(spark, sf_dir), "ts", "event_type", "1 day")
    counts.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    table = spark.read.parquet(f"{at}/counts")
    # In complete mode the last batch holds all counts.
    last = table.agg(F.max("batch")).first()[0]
    return table.where(F.col("batch") == last).select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n")


@query("SELECT user_id, arg_max(value, ts) FILTER (event_id % 3 <> 0) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def stream_upsert_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest values of each user; a missing value never replaces one."""
    at = _shared(spark)
    stream = _stream(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    S.upsert_stream(stream, f"{at}/table", f"{at}/checkpoint", ["user_id"], ["value", "event_type"], "ts", "event_id").awaitTermination()
    return Table(spark, f"{at}/table", ["user_id"]).read()


@query("SELECT user_id, arg_min(value, ts) AS opening, arg_max(value, ts) AS latest, round(arg_max(value, ts) - arg_min(value, ts) + 3e-10, 6) + 0e0 AS movement, count(*) AS n FROM events GROUP BY user_id")
def stream_line_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _shared(spark)
    S.history_stream(_stream(spark, sf_dir), f"{at}/table", f"{at}/checkpoint", ["user_id"], "value", "ts").awaitTermination()
    return S.movements(Table(spark, f"{at}/table", ["user_id"]).read(), ["user_id"]).withColumn("movement", R(F.col("movement")))


@query("""WITH w AS (SELECT user_id, unnest([time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(k AS INTEGER)) for k in range(7)]) AS start FROM events) SELECT epoch_us(start) // 1000000 AS start, user_id, count(*) AS n FROM w GROUP BY ALL""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in windows of seven days that start every day; all windows, closed or open, in the last batch."""
    at = _shared(spark)

    def sink(df: DataFrame, batch: int) -> None:
        files.replace(df, f"{at}/counts")

    S.sliding_counts(_stream(spark, sf_dir), "ts", ["user_id"], "7 days", "1 day").writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return files.table(spark, f"{at}/counts").select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "user_id", "n")


def _earlier(days: int) -> str:
    return f"count(CASE WHEN b.s >= a.s - {days * 86400} AND (b.ts, b.event_id) < (a.ts, a.event_id) THEN 1 END) AS last_{days}_days"


@query(f"""WITH t AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) SELECT a.user_id, a.event_id, {', '.join(map(_earlier, (3, 7, 10)))}
FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.s BETWEEN a.s - 864000 AND a.s GROUP BY a.user_id, a.event_id""")
def stream_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event the number of its user's earlier events in the last days, from state by user; given out once the watermark has passed it."""
    at = _shared(spark)
    counts = trailing_counts(_stream(spark, sf_dir), "ts", ["user_id"], "event_id", (3, 7, 10))
    with S.rocksdb(spark):
        counts.writeStream.format("parquet").option("path", f"{at}/counts").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/counts").drop("ts")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 35 = 0 THEN 'failed' ELSE 'done' END AS status, CAST(CASE WHEN o_orderkey % 35 = 0 THEN 3 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN o_orderkey % 35 <> 0 THEN o_orderkey * 2 END AS doubled FROM orders""")
def resume_with_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work on all orders, of which some fail once and some always: a ledger says what is done and what is tried again, three times at most."""
    ledger = Ledger(spark, new_dir(spark, "ledger"), "o_orderkey", most=3)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")

    def work(todo: DataFrame) -> DataFrame:
        ok = (F.col("o_orderkey") % 35 != 0) & ((F.col("o_orderkey") % 7 != 0) | (F.col("attempts") > 0))
        return todo.select("o_orderkey", F.when(~ok, "no answer").alias("error"), F.when(ok, F.col("o_orderkey") * 2).alias("doubled"))

    while ledger.run(orders, work):
        pass
    return ledger.entries().select("o_orderkey", "status", "attempts").join(ledger.data(), "o_orderkey", "left")
