"""Cleaning of single columns. Missing is null everywhere: NaN and unreadable values become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(c: Column) -> Column:
    """A number, or null where the value is no finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def whole(c: Column, default: int | None = None) -> Column:
    """An integer, cut towards zero; default where there is none."""
    x = num(c)
    return F.coalesce(F.when(F.abs(x) < 9e18, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")), F.lit(default).cast("long"))


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    return F.coalesce(a / F.when(b != 0, b), F.lit(default).cast("double"))


def made_attempt(c: Column) -> Column:
    """'5-10' or '3/7' as a struct of made and att; a part that can't be read counts 0, and so do both without a separator."""
    parts = F.split(F.trim(c), "[-/]", 2)
    made, att = (F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("long"), F.lit(0)) for k in (1, 2))
    two = F.coalesce(F.size(parts) == 2, F.lit(False))
    return F.struct(F.when(two, made).otherwise(0).alias("made"), F.when(two, att).otherwise(0).alias("att"))


def side(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(~low.isin("", "nan", "none"), low)


def flip(c: Column) -> Column:
    """The other side of home and away."""
    return F.when(side(c) == "home", "away").when(side(c) == "away", "home")


def norm_id(c: Column) -> Column:
    """An id as text without a trailing '.0'."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(~F.lower(text).isin("", "nan", "none"), text)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0"), F.lit(False))


def flag(df: DataFrame, name: str) -> Column:
    """A flag column as true or false; true where the table has no such column."""
    return truthy(F.col(name)) if name in df.columns else F.lit(True)


def beside(df: DataFrame, nested: str, prefix: str = "") -> DataFrame:
    """The fields of a struct beside the table's columns; fields whose names are taken are left out, as the table's own columns come first."""
    fields = [f.name for f in df.schema[nested].dataType if prefix + f.name not in df.columns]
    return df.select(*[c for c in df.columns if c != nested], *[F.col(nested)[f].alias(prefix + f) for f in fields])


def int_in_range(c: Column, most: int) -> Column:
    """The integer part of a plain non-negative number up to most."""
    x = F.when(c.rlike(r"^\d+(\.\d+)?$"), F.floor(c.try_cast("double")))
    return F.when(x.between(0, most), x.cast("long"))


def clip(c: Column, low: float, high: float) -> Column:
    """Between low and high; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that the table has with any value; null if none has one. One aggregate, and only where several are there."""
    there = [n for n in names if n in df.columns]
    if len(there) > 1:
        found = df.agg(*[F.count(n).alias(n) for n in there]).first()
        there = [n for n in there if found[n]] or there
    return F.col(there[0]) if there else F.lit(None)


def clean_name(name: str) -> str:
    """A column name in lower case, with '_' for blanks, 'pct' for '%', and no stops."""
    return name.strip().lower().replace(" ", "_").replace(".", "").replace("%", "pct")


def rounded(c: Column, places: int = 6) -> Column:
    """For comparison across engines: rounded, never a negative zero, and off the exact ties that two summation orders settle differently."""
    return F.round(c + F.lit(3e-10), places) + F.lit(0.0)
