"""Gates before a merge, completion of required columns, and merges that leave an audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipline.operators.joins import pick


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows that have all required values; a column the table lacks is present in no row."""
    keep = F.lit(True)
    for n in names:
        keep = keep & (present(F.col(n)) if n in df.columns else F.lit(False))
    return df.where(keep)


def defaults(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Blank or missing values of required columns take their defaults; columns the table lacks are added."""
    return df.withColumns({n: F.when(present(F.col(n)), F.col(n)).otherwise(v) if n in df.columns else v for n, v in values.items()})


def made_up_id(c: Column, *parts: Column) -> Column:
    """The id, or one made of the parts where there is none: the same for the same parts."""
    return F.when(present(c), c.cast("string")).otherwise(F.concat_ws(":", F.lit("missing"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def split_moment(df: DataFrame, day: str, moment: str) -> DataFrame:
    """Repairs rows whose moment slipped into the day's column: the moment moves where it belongs, if it is missing there, and the day keeps its date."""
    slipped = F.coalesce(F.contains(F.col(day), F.lit("T")), F.lit(False))
    return df.withColumns({moment: F.when(slipped & ~present(F.col(moment)), F.col(day)).otherwise(F.col(moment)), day: F.when(slipped, F.substring_index(day, "T", 1)).otherwise(F.col(day))})


def named(c: Column, tokens: Sequence[str]) -> Column:
    """Whether the value, in lower case, is one of the tokens; a missing one is not."""
    return F.lower(F.coalesce(c.cast("string"), F.lit(""))).isin(*tokens)


def integrity(df: DataFrame, columns: Sequence[str], side: str, moment: str, most_bad: float = 0.10) -> DataFrame:
    """One row per check: check, value, ok. Required columns, sides other than home and away, and the share of unreadable moments. One aggregate."""
    missing = [c for c in columns if c not in df.columns]
    bad_side = F.col(side).isNotNull() & ~F.col(side).isin("home", "away")
    found = df.agg(F.count("*").alias("n"), F.count_if(bad_side).alias("sides"), F.count_if(F.col(moment).try_cast("timestamp").isNull()).alias("moments"))
    share = F.col("moments") / F.greatest(F.lit(1), F.col("n"))
    checks = [("rows", F.col("n").cast("double"), F.col("n") > 0), ("missing_columns", F.lit(float(len(missing))), F.lit(not missing)), ("bad_sides", F.col("sides").cast("double"), F.col("sides") == 0), ("bad_moments", share, share <= most_bad)]
    return found.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("value"), ok.alias("ok")) for n, v, ok in checks])))


def preflight(df: DataFrame, not_null: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """column, nulls and misfits (values that do not cast to the column's kind), before a table is loaded. One aggregate over all columns."""
    names = list(dict.fromkeys([*not_null, *kinds]))
    misfit = {c: present(F.col(c)) & F.col(c).cast("string").try_cast(kind).isNull() for c, kind in kinds.items()}
    rows = [F.struct(F.lit(c).alias("column"), (F.count_if(~present(F.col(c))) if c in not_null else F.lit(0)).cast("long").alias("nulls"), (F.count_if(misfit[c]) if c in misfit else F.lit(0)).cast("long").alias("misfits")) for c in names]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def completeness_level(df: DataFrame, source: str, fields: Sequence[str], expected: Sequence[str] = ()) -> DataFrame:
    """One row per source: mean share of fields present, and HIGH (0.8), MEDIUM (0.5), LOW, or FAILED for an expected source without a row."""
    share = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)) / len(fields)
    found = df.groupBy(source).agg(F.avg(share).alias("completeness"), F.count("*").alias("n"))
    if expected:
        every = df.sparkSession.createDataFrame([(s,) for s in expected], f"{source} string")
        found = found.join(F.broadcast(every), source, "full")
    level = F.when(F.col("completeness") >= 0.8, "HIGH").when(F.col("completeness") >= 0.5, "MEDIUM").when(F.col("n") > 0, "LOW").otherwise("FAILED")
    return found.withColumns({"level": level, "n": F.coalesce("n", F.lit(0))})


def audit_id(*parts: Column) -> Column:
    """The same id for the same finding."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Old rows, and the new ones, once each, whose key is not there yet; of new rows that share a key, the first in the order, which must decide every tie."""
    return old.unionByName(pick(new, [key], order).join(old.select(key), key, "left_anti"))


def delete_audited(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """What stays, and the audit of what goes: all columns and the first reason that holds. Both read the same flags, so a row is in exactly one."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()])
    flagged = df.withColumn("reason", reason)
    return flagged.where("reason IS NULL").drop("reason"), flagged.where("reason IS NOT NULL")


def upsert_latest(old: DataFrame, staging: DataFrame, keys: list[str], recent: str, tie: list[str]) -> DataFrame:
    """The old table with the latest staged row of each key in place of its own."""
    newest = pick(staging, keys, [F.desc_nulls_last(recent), *[F.col(c).asc_nulls_last() for c in tie]])
    return old.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*old.columns))


def with_suffixes(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str, how: str = "left") -> DataFrame:
    """Joined on the first of the keys that both tables have; right columns that the left one has, too, carry the suffix."""
    key = next(k for k in keys if k in left.columns and k in right.columns)
    renamed = right.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key])
    return left.join(renamed, key, how)


def ends_with(columns: Sequence[str], suffixes: Sequence[str] = (), prefixes: Sequence[str] = ()) -> list[str]:
    """Names that end or start as asked, in order."""
    return [c for c in columns if c.endswith(tuple(suffixes) or "\0") or c.startswith(tuple(prefixes) or "\0")]


def mean_or_zero(df: DataFrame, names: dict[str, str], combine: dict[str, Callable] | None = None) -> DataFrame:
    """One row: the mean of each named column, nulls as 0; 0 for a column that the table lacks or a table without rows."""
    return df.agg(*[F.coalesce(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c in df.columns else F.lit(0.0), F.lit(0.0)).alias(out) for out, c in names.items()])


def reshaped(df: DataFrame, aliases: dict[str, Sequence[str]], extra: str = "_extra") -> DataFrame:
    """The table under the names of a fixed layout: each taken from the first alias that is there (any case, blanks as '_'), null where none is; all other
    columns go, as JSON without nulls, into the extra column."""
    there = {c.strip().lower().replace(" ", "_"): c for c in reversed(df.columns)}
    taken = {name: next((there[a] for a in (name, *also) if a in there), None) for name, also in aliases.items()}
    rest = [c for c in df.columns if c not in taken.values()]
    own = [F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in taken.items()]
    packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("{}")
    return df.select(*own, packed.alias(extra))
