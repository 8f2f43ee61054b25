"""Queries that summarise, price, fit and test predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.functions import betting as B
from tipline.functions import columns as C
from tipline.operators import aggregates as A
from tipline.operators import models as M
from tipline.operators import windows as W
from tipline.operators.selection import quantiles
from tipline.plans.adapter import GAMES, ORDER, TG, games, team_games
from tipline.plans.registry import query

R = C.rounded


def _r(sql: str, places: int = 6) -> str:
    return f"round({sql} + 3e-10, {places}) + 0e0"


def _rounded(df: DataFrame, keys: list[str], names: list[str], places: int = 6) -> DataFrame:
    return df.select(*keys, *[R(F.col(n), places).alias(n) for n in names])


@query("""WITH t AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT l_partkey, q, sum(q) OVER (PARTITION BY l_partkey) AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC NULLS LAST, l_suppkey) AS rn FROM t)
SELECT l_partkey, round(sum((q / total) * (q / total)) + 3e-10, 6) + 0e0 AS hhi, round(sum(CASE WHEN rn <= 3 THEN q / total ELSE 0 END) + 3e-10, 6) + 0e0 AS top3_share FROM s GROUP BY l_partkey""")
def agg_hhi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return _rounded(A.concentration(totals, ["l_partkey"], "q", "l_suppkey"), ["l_partkey"], ["hhi", "top3_share"])


_BUCKET = "CASE WHEN abs(pred - line) >= 20 THEN '20+' WHEN abs(pred - line) >= 10 THEN '10-20' WHEN abs(pred - line) >= 5 THEN '5-10' WHEN abs(pred - line) >= 2 THEN '2-5' WHEN abs(pred - line) >= 0 THEN '0-2' ELSE 'nan' END"


@query(f"""WITH {GAMES}, l AS (SELECT unnest(['0-2', '2-5', '5-10', '10-20', '20+', 'nan']) AS bucket), b AS (SELECT {_BUCKET} AS bucket, count(*) AS n, avg(abs(pred - margin)) AS mae, sqrt(avg((pred - margin) * (pred - margin))) AS rmse, avg(pred - margin) AS bias, avg(CASE WHEN margin <> 0 THEN CASE WHEN sign(pred) = sign(margin) THEN 1e0 ELSE 0e0 END END) AS acc FROM games GROUP BY 1)
SELECT l.bucket, COALESCE(n, 0) AS n, {_r('mae')} AS mae, {_r('rmse')} AS rmse, {_r('bias')} AS bias, {_r('acc')} AS winner_accuracy FROM l LEFT JOIN b ON l.bucket = b.bucket""")
def agg_conf_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = games(spark, sf_dir).withColumn("edge", F.abs(F.col("pred") - F.col("line")))
    return _rounded(A.bucketed(df, "edge", A.errors("pred", "margin")), ["bucket", "n"], ["mae", "rmse", "bias", "winner_accuracy"])


@query(f"""WITH {GAMES} SELECT home_id, {_r('avg(abs(pred - line))')} AS avg_edge, {_r('avg(CASE WHEN margin <> line AND pred <> line THEN CASE WHEN sign(pred - line) = sign(margin - line) THEN 1e0 ELSE 0e0 END END)')} AS hit_rate,
count(CASE WHEN margin <> line AND pred <> line THEN 1 END) AS n_bets FROM games GROUP BY home_id""")
def agg_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = games(spark, sf_dir).groupBy("home_id").agg(*A.against_line("pred", "margin", "line"))
    return _rounded(out, ["home_id", "n_bets"], ["avg_edge", "hit_rate"])


_WON = "CASE WHEN margin <> line AND pred <> line THEN CASE WHEN sign(pred - line) = sign(margin - line) THEN 1 ELSE 0 END END"


def _bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir)
    edge, cover = F.col("pred") - F.col("line"), F.col("margin") - F.col("line")
    return g.withColumns({"edge": edge, "won": F.when((edge != 0) & (cover != 0), (F.signum(edge) == F.signum(cover)).cast("int"))})


@query(f"""WITH {GAMES}, b AS (SELECT abs(pred - line) AS e, {_WON} AS won FROM games), s AS (SELECT CAST(unnest([0, 1, 2, 3, 4, 5]) AS DOUBLE) AS threshold), r AS (SELECT threshold, count(won) AS n, (count(CASE WHEN won = 1 THEN 1 END) * 100e0 - count(CASE WHEN won = 0 THEN 1 END) * 110e0) / nullif(count(won) * 110e0, 0) AS roi FROM s LEFT JOIN b ON e >= threshold GROUP BY threshold)
SELECT threshold, n, {_r('roi')} AS roi, COALESCE(threshold = (SELECT threshold FROM r WHERE n >= 3 ORDER BY roi DESC, threshold LIMIT 1), false) AS is_best FROM r""")
def agg_value_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_scan(_bets(spark, sf_dir), "edge", "won").withColumn("roi", R(F.col("roi")))


@query(f"""WITH {GAMES}, b AS (SELECT game_id % 4 AS market, abs(pred - line) AS e, {_WON} AS won FROM games) SELECT market, count(*) AS n, {_r('avg(e)')} AS avg_edge, {_r('median(e)')} AS median_edge,
{_r("(count(CASE WHEN won = 1 THEN 1 END) * 100e0 - count(CASE WHEN won = 0 THEN 1 END) * 110e0) / nullif(count(won) * 110e0, 0)")} AS roi FROM b GROUP BY market""")
def agg_leaderboard_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs("edge")
    out = _bets(spark, sf_dir).groupBy((F.col("game_id") % 4).alias("market")).agg(F.count("*").alias("n"), F.avg(e).alias("avg_edge"), F.median(e).alias("median_edge"), A.roi_110(F.col("won")).alias("roi"))
    return _rounded(out, ["market", "n"], ["avg_edge", "median_edge", "roi"])


@query(f"WITH {GAMES}, e AS (SELECT abs(pred - line) AS e FROM games) SELECT count(CASE WHEN e < 3 THEN 1 END) AS e0_3, count(CASE WHEN e >= 3 AND e < 6 THEN 1 END) AS e3_6, count(CASE WHEN e >= 6 AND e < 9 THEN 1 END) AS e6_9, count(CASE WHEN e >= 9 THEN 1 END) AS e9 FROM e")
def agg_edge_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs("edge")
    return _bets(spark, sf_dir).agg(F.count_if(e < 3).alias("e0_3"), F.count_if((e >= 3) & (e < 6)).alias("e3_6"), F.count_if((e >= 6) & (e < 9)).alias("e6_9"), F.count_if(e >= 9).alias("e9"))


@query(f"WITH {GAMES} SELECT game_id, {_r('greatest(abs(pred - margin), abs(line - margin))')} AS worst FROM games ORDER BY greatest(abs(pred - margin), abs(line - margin)) DESC, game_id LIMIT 25")
def agg_worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = F.greatest(F.abs(F.col("pred") - F.col("margin")), F.abs(F.col("line") - F.col("margin")))
    return games(spark, sf_dir).withColumn("worst", worst).orderBy(F.desc("worst"), "game_id").limit(25).select("game_id", R(F.col("worst")).alias("worst"))


@query("""SELECT * FROM (SELECT 'p_name' AS "column", avg(CASE WHEN p_name IS NULL THEN 1e0 ELSE 0e0 END) AS missing, count(DISTINCT p_name) AS n_distinct, round(avg(length(p_name)) + 3e-10, 6) + 0e0 AS mean_length, max(length(p_name)) AS max_length FROM part
UNION ALL SELECT 'p_brand', avg(CASE WHEN p_brand IS NULL THEN 1e0 ELSE 0e0 END), count(DISTINCT p_brand), round(avg(length(p_brand)) + 3e-10, 6) + 0e0, max(length(p_brand)) FROM part)""")
def agg_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.column_profile(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_name", "p_brand"]).withColumn("mean_length", R(F.col("mean_length")))


@query("SELECT round(median(l_quantity) + 3e-10, 6) + 0e0 AS median_quantity, round(stddev_pop(l_discount) + 3e-10, 6) + 0e0 AS std_discount, round(corr(l_quantity, l_extendedprice) + 3e-10, 6) + 0e0 AS correlation FROM lineitem")
def agg_medians_std_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.agg(R(F.median("l_quantity")).alias("median_quantity"), R(F.stddev_pop("l_discount")).alias("std_discount"), R(F.corr("l_quantity", "l_extendedprice")).alias("correlation"))


@query(f"WITH {GAMES}, k AS (SELECT game_id, home_id, conf / 10 AS stake, sum(conf / 10) OVER (PARTITION BY home_id) AS total FROM games) SELECT game_id, {_r('CASE WHEN total > 0.15 THEN stake * 0.15e0 / total ELSE stake END')} AS capped FROM k")
def agg_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = games(spark, sf_dir).withColumn("stake", F.col("conf") / 10)
    return _rounded(A.capped(df, "stake", "home_id", 0.15, "capped"), ["game_id"], ["capped"])


_P = "1 / (1 + exp(-pred / 10))"


@query(f"""WITH {GAMES}, p AS (SELECT {_P} AS p, CASE WHEN margin > 0 THEN 1e0 ELSE 0e0 END AS y FROM games), b AS (SELECT least(floor(p * 10), 9) AS k, count(*) AS n, sum(-(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(1 - least(p, 1 - 1e-15)))) AS l, sum((p - y) * (p - y)) AS s, avg(p) AS ap, avg(y) AS ay FROM p GROUP BY 1)
SELECT {_r('sum(l) / sum(n)')} AS log_loss, {_r('sum(s) / sum(n)')} AS brier, {_r('sum(n * abs(ap - ay)) / sum(n)')} AS ece FROM b""")
def calib_logloss_brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = games(spark, sf_dir).select((1 / (1 + F.exp(-F.col("pred") / 10))).alias("p"), F.when(F.col("margin") > 0, 1.0).otherwise(0.0).alias("y"))
    return _rounded(A.calibration(df, "p", "y"), [], ["log_loss", "brier", "ece"])


@query()
def calib_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = games(spark, sf_dir).withColumn("y", F.when(F.col("margin") > 0, 1.0).otherwise(0.0))
    slope, constant = M.platt(df, "pred", "y")
    return spark.createDataFrame([(slope, constant)], "slope double, constant double")


@query(f"""WITH {GAMES} SELECT i, j, round(value / 1000 + 3e-10, 4) + 0e0 AS value FROM (SELECT unnest(['one', 'one', 'one', 'one', 'h_ortg', 'h_ortg', 'h_ortg', 'h_poss', 'h_poss', 'y']) AS i, unnest(['one', 'h_ortg', 'h_poss', 'y', 'h_ortg', 'h_poss', 'y', 'h_poss', 'y', 'y']) AS j,
unnest([CAST(count(*) AS DOUBLE), sum(h_ortg), sum(h_poss), sum(margin), sum(h_ortg * h_ortg), sum(h_ortg * h_poss), sum(h_ortg * margin), sum(h_poss * h_poss), sum(h_poss * margin), sum(margin * margin)]) AS value FROM games)""")
def ridge_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.normal_equations(games(spark, sf_dir), ["h_ortg", "h_poss"], "margin").withColumn("value", R(F.col("value") / 1000, 4))


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game with both sides' earlier means."""
    from tipline.operators.joins import home_away

    w = W.before(["team_id"], ORDER, 7)
    df = team_games(spark, sf_dir).withColumns({"ortg_pre": W.mean(F.col("ortg"), w), "poss_pre": W.mean(F.col("poss"), w)})
    both = home_away(df, "game_id", "home_away", ["game_dt", "points", "ortg_pre", "poss_pre"])
    return both.selectExpr("game_id", "h_game_dt AS game_dt", "h_points - a_points AS margin", "h_ortg_pre - a_ortg_pre AS ortg_diff", "h_poss_pre - a_poss_pre AS poss_diff")


_OVER7 = "OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
_ROLLED = f"""{TG}, pre AS (SELECT *, avg(ortg) {_OVER7} AS op, avg(poss) {_OVER7} AS pp FROM tg),
rolled AS (SELECT h.game_id, h.game_dt, epoch_us(h.game_dt) // 1000000 AS sec, h.points - a.points AS margin, h.op - a.op AS o, h.pp - a.pp AS p FROM pre h JOIN pre a ON h.game_id = a.game_id AND h.home_away = 'home' AND a.home_away = 'away')"""


def _fit(source: str, name: str) -> str:
    """Closed form of a ridge model of two features (penalty 0.01, free constant, medians for missing values): ends in {name}(d1, d2, wa, wb, w0)."""
    return f"""{name}_d AS (SELECT coalesce(median(o), 0) AS d1, coalesce(median(p), 0) AS d2 FROM {source}), {name}_x AS (SELECT coalesce(o, d1) AS a, coalesce(p, d2) AS b, margin AS y, d1, d2 FROM {source}, {name}_d),
{name}_m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM {name}_x), {name}_s AS (SELECT min(d1) AS d1, min(d2) AS d2, min(ma) AS ma, min(mb) AS mb, min(my) AS my, sum((a - ma) * (a - ma)) + 0.01e0 AS aa, sum((b - mb) * (b - mb)) + 0.01e0 AS bb,
sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS yb FROM {name}_x, {name}_m),
{name}_w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM {name}_s), {name} AS (SELECT d1, d2, wa, wb, my - wa * ma - wb * mb AS w0 FROM {name}_w)"""


_PREDICTED = _r("w0 + wa * coalesce(o, d1) + wb * coalesce(p, d2)", 3)


@query(f"WITH {_ROLLED}, {_fit('rolled', 'model')} SELECT game_id, margin, {_PREDICTED} AS prediction FROM rolled, model")
def ridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins predicted by a ridge model of all games; missing features take the median."""
    df, features = _rolled(spark, sf_dir), ["ortg_diff", "poss_diff"]
    filled, medians = M.imputed(df, features)
    weights = M.ridge(filled, features, "margin")
    return df.select("game_id", "margin", R(M.linear(weights, medians), 3).alias("prediction"))


@query(f"""WITH {_ROLLED}, cut AS (SELECT CAST(floor(quantile_cont(CAST(sec AS DOUBLE), 0.4)) AS BIGINT) AS c1, CAST(floor(quantile_cont(CAST(sec AS DOUBLE), 0.7)) AS BIGINT) AS c2 FROM rolled),
p1 AS (SELECT rolled.* FROM rolled, cut WHERE sec < c1), p2 AS (SELECT rolled.* FROM rolled, cut WHERE sec < c2), {_fit('p1', 'm1')}, {_fit('p2', 'm2')}
SELECT game_id, 0 AS fold, margin, {_PREDICTED} AS prediction FROM rolled, cut, m1 WHERE sec >= c1 AND sec < c2 UNION ALL SELECT game_id, 1, margin, {_PREDICTED} FROM rolled, cut, m2 WHERE sec >= c2""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rolled(spark, sf_dir)
    span = df.agg(F.percentile(F.unix_seconds(F.col("game_dt").cast("timestamp")), F.array(F.lit(0.4), F.lit(0.7))).alias("q")).first().q
    df = df.withColumn("at", F.unix_seconds(F.col("game_dt").cast("timestamp")))
    return M.walk_forward(df, "at", ["ortg_diff", "poss_diff"], "margin", [int(x) for x in span]).select("game_id", "fold", "margin", R(F.col("prediction"), 3).alias("prediction"))


_SPANS = (3, 5, 7, 10)


def _pairs() -> list[tuple[int, int]]:
    return [(_SPANS[i], _SPANS[j]) for i in range(len(_SPANS)) for j in [i, *range(i + 2, len(_SPANS))]]


@query(f"""WITH {TG}, pre AS (SELECT *, {', '.join(f'avg(ortg) OVER (PARTITION BY team_id ORDER BY game_dt, game_id, home_away ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS o{n}' for n in _SPANS)} FROM tg),
g AS (SELECT h.points - a.points AS y, {', '.join(f'h.o{n} - a.o{n} AS x{n}' for n in _SPANS)} FROM pre h JOIN pre a ON h.game_id = a.game_id AND h.home_away = 'home' AND a.home_away = 'away' WHERE h.o3 IS NOT NULL AND a.o3 IS NOT NULL),
f AS (SELECT {', '.join(f'regr_slope(y, x{n}) AS s{n}, regr_intercept(y, x{n}) AS c{n}' for n in _SPANS)} FROM g)
{' UNION ALL '.join(f"SELECT 'ortg_l{a}' AS a, 'ortg_l{b}' AS b, {_r(f'sqrt(avg(pow((s{a} * x{a} + c{a} + s{b} * x{b} + c{b}) / 2 - y, 2)))', 4)} AS rmse FROM g, f" for a, b in _pairs())}""")
def window_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins by rating differences over windows of several lengths: each alone, and halves of two that are at least two steps apart."""
    from tipline.operators.joins import home_away

    df = team_games(spark, sf_dir).withColumns({f"o{n}": W.mean(F.col("ortg"), W.before(["team_id"], ORDER, n)) for n in _SPANS})
    both = home_away(df, "game_id", "home_away", ["points", *[f"o{n}" for n in _SPANS]])
    both = both.withColumns({"y": F.col("h_points") - F.col("a_points"), **{f"ortg_l{n}": F.col(f"h_o{n}") - F.col(f"a_o{n}") for n in _SPANS}})
    return M.variants(both, [f"ortg_l{n}" for n in _SPANS], "y").select("a", "b", R(F.col("rmse"), 4).alias("rmse"))


@query(f"""WITH {GAMES}, w AS (SELECT a / 10e0 AS w_pred, (10 - a) / 10e0 AS w_line FROM (SELECT unnest(range(11)) AS a)) SELECT w_pred, w_line, (SELECT {_r('sqrt(avg((w_pred * pred + w_line * line - margin) * (w_pred * pred + w_line * line - margin)))', 4)} FROM games) AS rmse FROM w""")
def ensemble_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.ensemble_grid(games(spark, sf_dir), ["pred", "line"], "margin"), ["w_pred", "w_line"], ["rmse"], 4)


@query(f"""WITH {GAMES}, k AS (SELECT game_id, row_number() OVER (ORDER BY game_dt, game_id) - 1 AS pos, count(*) OVER () AS n FROM games), c AS (SELECT *, round_even(n * 0.2, 0) AS t FROM k) SELECT game_id, CASE WHEN pos >= n - t THEN 'test' WHEN pos >= n - 2 * t THEN 'val' ELSE 'train' END AS split FROM c""")
def split_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chronological(games(spark, sf_dir).select("game_id", "game_dt"), ["game_dt", "game_id"]).select("game_id", "split")


_IMPLIED = "CASE WHEN odds > 0 THEN 100 / (odds + 100) WHEN odds < 0 THEN -odds / (-odds + 100) END"
_PAY = "CASE WHEN odds > 0 THEN odds / 100 WHEN odds < 0 THEN 100 / -odds END"


@query(f"""WITH {GAMES}, p AS (SELECT game_id, odds, conf, {_IMPLIED} AS p, {_PAY} AS b FROM games) SELECT game_id, {_r('p')} AS prob, {_r('CASE WHEN p <= 0 OR p >= 1 THEN NULL WHEN p >= 0.5 THEN -100 * p / (1 - p) ELSE 100 * (1 - p) / p END')} AS american, {_r('p / (p + conf)')} AS fair,
{_r('100 * (conf * b - (1 - conf))')} AS ev, {_r('greatest(0, (b * conf - (1 - conf)) / b)')} AS kelly, {_r('CASE WHEN b IS NOT NULL THEN least(greatest(0, (b * conf - (1 - conf)) / b) * 0.25 * 3, 3) END')} AS units, COALESCE(conf - p >= 0.02 AND conf >= 0.7, false) AS passes FROM (SELECT * FROM p WHERE odds IS NOT NULL)""")
def odds_kelly_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, odds, conf = games(spark, sf_dir).where("odds IS NOT NULL"), F.col("odds"), F.col("conf")
    p = B.implied(odds)
    k = B.kelly(conf, odds)
    cols = {"prob": p, "american": B.american(p), "fair": B.without_vig(p, conf)[0], "ev": B.expected_value(conf, odds, 100), "kelly": k, "units": B.units(k)}
    return g.select("game_id", *[R(c).alias(n) for n, c in cols.items()], B.passes(conf - p, conf).alias("passes"))


@query(f"""WITH {GAMES}, e AS (SELECT *, pred + line AS edge, least(greatest(0.5 + abs(pred + line) / 20, 0.05), 0.95) AS p FROM games), b AS (SELECT *, CASE WHEN edge >= 2 THEN 'home' WHEN edge <= -2 THEN 'away' ELSE 'none' END AS bet FROM e),
r AS (SELECT *, CASE WHEN bet = 'home' THEN CASE WHEN margin + line > 0 THEN 1e0 WHEN margin + line < 0 THEN 0e0 ELSE 0.5e0 END WHEN bet = 'away' THEN CASE WHEN margin + line > 0 THEN 0e0 WHEN margin + line < 0 THEN 1e0 ELSE 0.5e0 END END AS result FROM b)
SELECT game_id, bet, {_r('p')} AS win_prob, {_r('p * 0.91 - (1 - p)')} AS ev, {_r('greatest(0, (0.91 * p - (1 - p)) / 0.91)')} AS kelly, {_r('1 - exp(-abs(edge) / 6)')} AS confidence,
CASE WHEN abs(edge) >= 6 AND conf >= 0.75 THEN 'A' WHEN abs(edge) >= 4 AND conf >= 0.65 THEN 'B' WHEN abs(edge) >= 2.5 AND conf >= 0.55 THEN 'C' ELSE 'none' END AS tier, result, {_r('CASE WHEN result = 1 THEN 100 / 110e0 WHEN result = 0 THEN -1 WHEN result = 0.5 THEN 0 END')} AS profit FROM r""")
def bet_recommend_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.spread_bet(F.col("pred"), F.col("line"))
    g = games(spark, sf_dir).withColumns(s)
    result = B.ats_result(F.col("margin"), F.col("line"), F.col("bet"))
    out = g.withColumns({"confidence": B.confidence(F.col("edge")), "tier": B.edge_tier(F.col("edge"), F.col("conf")), "result": result})
    return _rounded(out.withColumn("profit", B.profit(F.col("result"))), ["game_id", "bet", "tier", "result"], ["win_prob", "ev", "kelly", "confidence", "profit"])


@query(f"WITH {GAMES} SELECT game_id, {_r('conf')} AS conf FROM games WHERE conf >= 0.7 AND abs(pred - line) >= 3")
def filter_value_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(games(spark, sf_dir).where("conf >= 0.7 AND abs(pred - line) >= 3"), ["game_id"], ["conf"])


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'")
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive days, written as a range of times, so that the filter reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderdate >= timestamp'1995-03-01' AND o_orderdate < timestamp'1995-07-01'").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def filter_today_or_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    latest = orders.agg(F.max(F.to_date("o_orderdate")).alias("d"))
    return orders.join(F.broadcast(latest), F.to_date("o_orderdate") == F.col("d")).select("o_orderkey")


@query(f"""WITH {GAMES} SELECT game_id, {_r('(0.6 * COALESCE(h_ortg - a_ortg, 0) + 0.2 * COALESCE(h_poss - a_poss, 0)) * 68 / 100 + 3.2')} AS spread FROM games""")
def formula_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, away = ({"ortg": F.col(f"{s}_ortg"), "poss": F.col(f"{s}_poss")} for s in "ha")
    spread = M.formula_spread(home, away, {"ortg": 0.6, "poss": 0.2}, 3.2, 68.0)
    return _rounded(games(spark, sf_dir).withColumn("spread", spread), ["game_id"], ["spread"])


@query()
def bankroll_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = games(spark, sf_dir).where("odds IS NOT NULL").select(F.col("game_id").alias("bet_id"), "conf", "odds")
    return M.bankrolls(bets, "conf", "odds", 50)


_CUTS = ("2024-01-08", "2024-01-15", "2024-01-22")


def _fits() -> str:
    """Ridge weights of each fold in centred form (the constant is not penalised): both features, and each alone."""
    moments = ", ".join(f"sum({a} * {b}) - sum({a}) * sum({b}) / count(*) AS {a[0]}{b[0]}" for a, b in (("poss", "poss"), ("poss", "fta"), ("fta", "fta"), ("poss", "target"), ("fta", "target")))
    spans = ", ".join(f"({k}, TIMESTAMP '{c}', TIMESTAMP '{n}')" for k, (c, n) in enumerate(zip(_CUTS, [*_CUTS[1:], "9999-01-01"], strict=True)))
    return f"""WITH {TG}, f(fold, low, high) AS (VALUES {spans}), d AS (SELECT poss, fta, points AS target, game_dt FROM tg WHERE points IS NOT NULL),
s AS (SELECT fold, low, high, count(*) AS n_train, avg(poss) AS mp, avg(fta) AS mf, avg(target) AS mt, {moments}, stddev_pop(poss) AS dev_p, stddev_pop(fta) AS dev_f FROM f JOIN d ON game_dt < low GROUP BY fold, low, high),
w AS (SELECT *, ((ff + 0.01e0) * pt - pf * ft) / ((pp + 0.01e0) * (ff + 0.01e0) - pf * pf) AS wp, ((pp + 0.01e0) * ft - pf * pt) / ((pp + 0.01e0) * (ff + 0.01e0) - pf * pf) AS wf, pt / (pp + 0.01e0) AS one_p, ft / (ff + 0.01e0) AS one_f FROM s),
e AS (SELECT fold, count(*) AS n_test, sqrt(avg((target - mt - wp * (poss - mp) - wf * (fta - mf)) ** 2)) AS rmse, sqrt(avg((target - mt - one_f * (fta - mf)) ** 2)) AS no_poss, sqrt(avg((target - mt - one_p * (poss - mp)) ** 2)) AS no_fta
  FROM w JOIN d ON game_dt >= low AND game_dt < high GROUP BY fold)"""


def _line(feature: str, weight: str, spread: str, without: str) -> str:
    return f"SELECT w.fold, '{feature}' AS feature, n_train, n_test, {_r(weight, 4)} AS weight, {_r(f'abs({weight}) * {spread}', 4)} AS importance, {_r('rmse', 4)} AS rmse, {_r(without, 4)} AS rmse_without FROM w JOIN e USING (fold)"


@query(f"{_fits()} {_line('poss', 'wp', 'dev_p', 'no_poss')} UNION ALL {_line('fta', 'wf', 'dev_f', 'no_fta')}")
def walk_forward_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature does in each fold, from one pass over the rows."""
    df = team_games(spark, sf_dir).withColumn("day", F.date_format("game_dt", "yyyy-MM-dd"))
    report = M.walk_forward_report(df, "day", ["poss", "fta"], "points", list(_CUTS))
    return report.select("fold", "feature", "n_train", "n_test", *[R(F.col(c), 4).alias(c) for c in ("weight", "importance", "rmse", "rmse_without")])


_MEASURED = ("l_quantity", "l_extendedprice", "l_discount", "part")


@query(f"""WITH l AS (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS DOUBLE) END AS part FROM lineitem) {' UNION ALL '.join(f"SELECT '{c}' AS name, round(quantile_cont({c}, 0.5) + 3e-10, 6) + 0e0 AS median FROM l" for c in _MEASURED)}""")
def agg_exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of several columns by refined histograms: no task holds a column's values."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("part", F.expr("CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS DOUBLE) END"))
    found = quantiles(lines, list(_MEASURED))
    return spark.createDataFrame(list(found.items()), "name string, median double").withColumn("median", R(F.col("median")))
