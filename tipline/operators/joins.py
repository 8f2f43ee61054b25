"""Joins and merges of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipline.functions.columns import flip


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order, which must decide every tie."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def opponent(df: DataFrame, event: str, side: str, columns: list[str], order: list[Column], prefix: str = "opp_") -> DataFrame:
    """Each row with the columns of the other side's row of the same event, and whether there is one. Columns of an earlier run are replaced."""
    df = df.drop(*[c for c in df.columns if c.startswith(prefix)])
    other = pick(df, [event, side], order).select(F.col(event).alias("_event"), flip(F.col(side)).alias("_side"), *[F.col(c).alias(f"{prefix}{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(other, (df[event] == other["_event"]) & (df[side] == other["_side"]), "left")
    return joined.withColumn(f"{prefix}join_ok", F.coalesce("_hit", F.lit(False))).drop("_event", "_side", "_hit")


def home_away(df: DataFrame, event: str, side: str, columns: list[str]) -> DataFrame:
    """One row per event with both sides: h_ and a_ columns. One aggregation, no self-join."""
    picks = [F.max(F.when(F.col(side) == s, F.struct(*columns))).alias(p) for s, p in (("home", "h"), ("away", "a"))]
    both = df.groupBy(event).agg(*picks).where("h IS NOT NULL AND a IS NOT NULL")
    return both.select(event, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ha" for c in columns])


def two_rows_each(df: DataFrame, event: str) -> DataFrame:
    """Rows of events that have exactly two rows."""
    return df.withColumn("_k", F.count("*").over(Window.partitionBy(event))).where("_k = 2").drop("_k")


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], tie: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at a strictly earlier time.

    Both sides are put in one order per key and the last right row is carried on: one shuffle, and no pairs of rows."""
    snap = right.select(F.col(key), F.col(right_time).alias("_t"), F.struct(*columns).alias("_snap"), F.struct(*tie).alias("_tie"))
    asked = left.select(F.col(key), F.col(left_time).alias("_t"), F.struct("*").alias("_row"))
    both = asked.withColumn("_after", F.lit(0)).unionByName(snap.withColumn("_after", F.lit(1)), allowMissingColumns=True)
    # At one time, questions come before snapshots: strictly earlier ones only.
    w = Window.partitionBy(key).orderBy("_t", "_after", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_snap", ignorenulls=True).over(w)).where("_after = 0").select("_row.*", *[F.col(f"_last.{c}").alias(f"asof_{c}") for c in columns])


def history(df: DataFrame, keys: list[str], order: list[str], columns: list[str], n: int, out: str) -> DataFrame:
    """Each row with the last n earlier rows of its key, oldest first, as an array of structs."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn(out, F.collect_list(F.struct(*columns)).over(w))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return pick(df, [key], [F.desc_nulls_last(c) for c in order])


def completeness(required: list[str], flags: dict[str, float], recent: str) -> Column:
    """Sum of the flags' weights, the share of required columns present, and a little for a time stamp."""
    score = sum((F.col(c).isNotNull().cast("int") for c in required), F.lit(0)) / F.lit(float(len(required)))
    for c, weight in flags.items():
        score = score + F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), weight).otherwise(0.0)
    return score + F.when(F.col(recent).isNotNull(), 0.05).otherwise(0.0)


def append_best(old: DataFrame, new: DataFrame, keys: list[str], score: Column, recent: str, tie: list[str]) -> DataFrame:
    """Old and new rows, one per key: the most complete, then the most recent."""
    return best(old.unionByName(new, allowMissingColumns=True), keys, score, recent, tie)


def best(rows: DataFrame, keys: list[str], score: Column, recent: str, tie: list[str]) -> DataFrame:
    """One row per key: the most complete, then the most recent."""
    return pick(rows.withColumn("_score", score), keys, [F.desc("_score"), F.desc_nulls_last(recent), *[F.col(c).asc_nulls_last() for c in tie]]).drop("_score")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values over old ones; a null never replaces a value."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, same, "full").select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])


def merge_sources(rows: DataFrame, keys: list[str], fields: list[str], priority: str) -> DataFrame:
    """One row per key from several sources: each field by majority, ties by the better source (smaller priority); and how many fields disagree.

    rows: one per key and source. Fields are compared as text, missing values do not vote."""
    votes = rows.select(*keys, priority, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v"))
    votes = votes.select(*keys, priority, "v.field", "v.value").where("value IS NOT NULL")
    counted = votes.groupBy(*keys, "field", "value").agg(F.count("*").alias("n"), F.min(priority).alias("best"))
    found = []
    for f in fields:
        own = F.col("field") == f
        found.append(F.min_by(F.when(own, F.col("value")), F.when(own, F.struct(-F.col("n"), F.col("best"), F.col("value")))).alias(f))
        found.append(F.count_if(own).alias(f"_k_{f}"))
    merged = counted.groupBy(*keys).agg(*found)
    conflicts = sum((F.when(F.col(f"_k_{f}") > 1, 1).otherwise(0) for f in fields), F.lit(0)).cast("long").alias("n_conflicts")
    sources = rows.groupBy(*keys).agg(F.count("*").alias("n_sources"))
    return sources.join(merged, keys, "left").select(*keys, "n_sources", *fields, F.coalesce(conflicts, F.lit(0)).alias("n_conflicts"))


def merge_games(rows: DataFrame, game: str, teams: tuple[str, str], priority: str, vote: list[str], fill: list[str]) -> DataFrame:
    """One row per game from several sources (rows: one per source and game; smaller priority is better).

    Rows that share an id but not the set of teams (any case, either order) with the best source's row are other games: their key is id_home_away. The best source's
    row is the base. A field of vote on which sources differ takes the value of most sources, the best source's of equals; fields of fill that the base lacks
    take the next source's value. Returns key, n_sources, the fields, and conflicts (field and the values as text). Each game is one group, as large as there
    are sources."""
    pair = F.array_sort(F.array(*[F.lower(F.col(t).cast("string")) for t in teams]))
    first = F.first("_pair").over(Window.partitionBy(game).orderBy(priority).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    other = F.concat_ws("_", game, *teams)
    keyed = rows.withColumn("_pair", pair).withColumn("key", F.when(first.eqNullSafe(F.col("_pair")), F.col(game).cast("string")).otherwise(other))
    fields = list(dict.fromkeys([*teams, *vote, *fill]))
    grouped = keyed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(priority, *fields))).alias("_all"))

    def values(f: str) -> Column:
        return F.filter(F.transform("_all", lambda r: r[f]), lambda v: v.isNotNull())

    def texts(f: str) -> Column:
        return F.transform(values(f), lambda v: v.cast("string"))

    def elected(f: str, kinds: Column) -> Column:
        # Kinds are in the order of sources, so that the first of equals is the better source's.
        ranked = F.transform(kinds, lambda v, i: F.struct((-F.size(F.filter(values(f), lambda x: x == v))).alias("votes"), i.alias("i"), v.alias("v")))
        return F.array_min(ranked)["v"]

    base, out, conflicts = F.col("_all")[0], {}, []
    for f in fields:
        own = base[f]
        if f in vote:
            kinds = F.array_distinct(values(f))
            differ = F.size(kinds) > 1
            own = F.when(differ, elected(f, kinds)).otherwise(own)
            conflicts.append(F.when(differ, F.struct(F.lit(f).alias("field"), texts(f).alias("values"))))
        if f in fill:
            own = F.coalesce(own, F.get(values(f), F.lit(0)))
        out[f] = own
    return grouped.select("key", F.size("_all").cast("long").alias("n_sources"), *[c.alias(f) for f, c in out.items()], F.array_compact(F.array(*conflicts)).alias("conflicts"))


def merge_report(merged: DataFrame) -> DataFrame:
    """One row: games, those from one and from more sources, conflicts in all and by field."""
    whole = merged.agg(F.count("*").alias("total_games"), F.count_if(F.col("n_sources") == 1).alias("games_from_single_source"), F.count_if(F.col("n_sources") > 1).alias("games_from_multiple_sources"), F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).alias("total_conflicts"))
    fields = merged.select(F.explode("conflicts.field").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    by_field = fields.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "n")))).alias("conflicts_by_field"))
    return whole.crossJoin(F.broadcast(by_field))  # one row each


def closest_names(left: DataFrame, right: DataFrame, name: str, cutoff: float = 0.92) -> DataFrame:
    """Each left name with the closest right one: equal, or at least cutoff alike by edit distance; among equals the smallest name wins.

    Names without an equal one are joined on segments: a right name is cut into one more segment than the edits that any partner may have, so
    that one segment is intact in every partner at the cutoff, shifted by no more than the edits before and after it allow."""
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    eps = 1e-9  # rounding must not lose a pair at the cutoff; similarity itself decides

    def floor(x: Column) -> Column:
        return F.floor(x + eps).cast("int")

    def edits(length: Column) -> Column:
        return floor(length * (1 - cutoff))

    # For a right name of b letters: the longest partner has b / cutoff, and segment i is the letters from start to end.
    b, i = F.col("b"), F.col("i")
    spots = F.sequence(F.lit(0), edits(floor(b / cutoff)))
    start, end = F.floor(i * b / F.size("spots")).cast("int"), F.floor((i + 1) * b / F.size("spots")).cast("int")
    lhs, rhs = left.select(F.col(name).alias("left_name")).distinct(), right.select(F.col(name).alias("right_name")).distinct()
    equal = lhs.join(rhs, F.col("left_name") == F.col("right_name"))
    rest = lhs.where("left_name IS NOT NULL").join(rhs, F.col("left_name") == F.col("right_name"), "left_anti")

    cut = rhs.where("right_name IS NOT NULL").select("right_name", F.length("right_name").alias("b")).withColumn("spots", spots)
    cut = cut.withColumn("i", F.explode("spots")).withColumn("segment", F.col("right_name").substr(start + 1, end - start)).select("b", "i", "segment", "right_name")

    a = F.length("left_name")
    asked = rest.withColumn("b", F.explode(F.sequence(F.ceil(a * cutoff - eps).cast("int"), floor(a / cutoff))))
    asked = asked.withColumn("spots", spots).withColumn("i", F.explode("spots"))
    more, most = a - b, edits(F.greatest(a, b))
    first, last = F.greatest(start + F.ceil((more - most) / 2).cast("int"), F.lit(0)), F.least(start + F.floor((more + most) / 2).cast("int"), a - (end - start))
    asked = asked.withColumn("at", F.explode(F.when(first <= last, F.sequence(first, last))))
    asked = asked.select("b", "i", F.col("left_name").substr(F.col("at") + 1, end - start).alias("segment"), "left_name").distinct()

    alike = 1 - F.levenshtein("left_name", "right_name") / F.greatest(F.length("left_name"), F.length("right_name"), F.lit(1))
    pairs = asked.join(cut, ["b", "i", "segment"]).withColumn("similarity", alike).where(F.col("similarity") >= cutoff)
    best = pairs.groupBy("left_name").agg(F.min_by(F.struct("right_name", "similarity"), F.struct(-F.col("similarity"), F.col("right_name"))).alias("m"))
    found = best.select("left_name", "m.right_name", "m.similarity").unionByName(equal.select("left_name", "right_name", F.lit(1.0).alias("similarity")))
    return lhs.join(found, "left_name", "left")
