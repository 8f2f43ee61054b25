"""Data-quality checks and repairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reasons(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def issues(df: DataFrame, completed: Column, inputs: list[str], derived: list[str]) -> DataFrame:
    """Completed rows that have all inputs but lack derived fields; missing_fields names them, joined by '|'."""
    ready = completed
    for c in inputs:
        ready = ready & F.col(c).isNotNull()
    missing = F.array_join(reasons({c: F.col(c).isNull() for c in derived}), "|")
    return df.where(ready).withColumn("missing_fields", missing).where("missing_fields <> ''")


def repair(df: DataFrame, formulas: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with missing derived fields recomputed, and the audit: one row per repaired field. Both read the same flagged rows."""
    fixed = df.withColumns({f"_fix_{c}": F.when(F.col(c).isNull(), f) for c, f in formulas.items()})
    audit = fixed.select("*", F.explode(reasons({c: F.col(f"_fix_{c}").isNotNull() for c in formulas})).alias("repaired_field"))
    whole = fixed.withColumns({c: F.coalesce(c, f"_fix_{c}") for c in formulas})
    extra = [f"_fix_{c}" for c in formulas]
    return whole.drop(*extra), audit.drop(*extra)


def report(df: DataFrame, required: list[str], ranges: dict[str, tuple[float, float]], keys: list[str], most_null: float = 0.5) -> DataFrame:
    """One row per finding: check, column, value, level. One aggregate over the data, and a second one for repeated keys."""
    absent = [(c, "missing_column") for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    rows = [F.struct(F.lit("null_rate").alias("check"), F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("value")) for c in present]
    rows += [F.struct(F.lit("out_of_range").alias("check"), F.lit(c).alias("column"), F.count_if((F.col(c) < a) | (F.col(c) > b)).cast("double").alias("value")) for c, (a, b) in ranges.items()]
    found = df.agg(F.array(*rows).alias("a")).select(F.inline("a"))
    repeated = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").cast("double").alias("value"))
    found = found.unionByName(repeated.select(F.lit("duplicate_keys").alias("check"), F.lit("|".join(keys)).alias("column"), "value"))
    if absent:
        found = found.unionByName(df.sparkSession.createDataFrame([(k, c, 1.0) for c, k in absent], "check string, column string, value double"))
    bad = (F.col("check") == "null_rate") & (F.col("value") > most_null) | (F.col("check") != "null_rate") & (F.col("value") > 0)
    return found.withColumn("level", F.when(bad & F.col("check").isin("duplicate_keys", "missing_column"), "error").when(bad, "warning").otherwise("ok"))


def calendar(df: DataFrame, day: str) -> DataFrame:
    """One row per calendar day between the first and the last: number of rows, and 'success' or 'empty'."""
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    counts = df.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    out = span.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") > 0, "success").otherwise("empty"))


LEAKS = ("actual", "final", "score_home", "score_away", "result", "target")


def leaking(names: list[str], words: tuple[str, ...] = LEAKS) -> list[str]:
    """Feature names that hint at what is to be predicted."""
    return [n for n in names if any(w in n.lower() for w in words) and not n.lower().endswith("_pre")]


def row_counts(spark: SparkSession, tables: dict[str, DataFrame | None], sources: dict[str, str]) -> DataFrame:
    """One row per table: name, present, n_rows and status. sources: the table that another one is made from; a table is told if it is empty and its source is
    not. The counts are one job; one row for each table is shuffled."""
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(True).alias("present"), "n_rows") for name, df in tables.items() if df is not None]
    absent = spark.createDataFrame([(n, False, None) for n, df in tables.items() if df is None], "name string, present boolean, n_rows long")
    for c in counted:
        absent = absent.unionByName(c)
    pairs = spark.createDataFrame(list(sources.items()), "name string, source string")
    origin = absent.select(F.col("name").alias("source"), F.col("n_rows").alias("_from"))
    rows = absent.join(F.broadcast(pairs), "name", "left").join(F.broadcast(origin), "source", "left")
    status = F.when(~F.col("present"), "missing").when((F.col("n_rows") == 0) & (F.col("_from") > 0), F.concat(F.lit("empty, but "), F.col("source"), F.lit(" has rows"))).when(F.col("n_rows") == 0, "empty").otherwise("ok")
    return rows.select("name", "present", "n_rows", status.alias("status"))


class Spec(NamedTuple):
    """What a column should hold: kind is number, text, time, flag or json; low and high bound a number."""

    name: str
    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None


# Words that say yes or no, and words in column names that hint at a result.
FLAG_WORDS = ("true", "false", "1", "0", "yes", "no", "y", "n", "t", "f")
HINTS = ("actual_", "final_", "result", "winner", "score_", "_score", "closing", "closing_line", "vegas_", "spread", "total")


def validate(df: DataFrame, specs: list[Spec], keys: list[str] = (), allowed: dict[str, list] | None = None, most_null: float = 0.5, least_rows: int = 10) -> DataFrame:
    """Findings as rows: code, column, value, severity. All columns are looked at in one aggregate over all rows, keys in a second.

    A column of flags should have 95 of 100 values that say yes or no, one of JSON 70 of 100 that parse as an object or a list or are blank; a column without
    values passes. Columns that the table lacks are found only if they are required; an empty table gives the one finding empty_df."""
    there, allowed = [s for s in specs if s.name in df.columns], allowed or {}
    cells = [F.count("*").alias("n")]
    for i, s in enumerate(there):
        c, t = F.col(s.name), F.trim(F.col(s.name).cast("string"))
        number = c.try_cast("double")
        looks = {
            "number": [F.count_if(number.isNotNull() & ~F.isnan(number)), F.min(F.when(~F.isnan(number), number)), F.max(F.when(~F.isnan(number), number))],
            "text": [F.count_if(t == "")], "time": [F.count(c.try_cast("timestamp"))], "flag": [F.count_if(F.lower(t).isin(*FLAG_WORDS))],
            "json": [F.count_if((t == "") | t.rlike(r"^[\{\[]") & F.try_parse_json(t).isNotNull())],
        }[s.kind]
        cells += [F.count(c).alias(f"c{i}"), *[x.alias(f"v{i}_{k}") for k, x in enumerate(looks)]]
    outside = {c: {str(v).strip() for v in values} for c, values in allowed.items() if c in df.columns}
    cells += [F.count_if(~F.trim(F.col(c).cast("string")).isin(*values)).alias(f"a{k}") for k, (c, values) in enumerate(outside.items())]
    row = df.agg(*cells).first()
    n, found = row.n, []
    if n and n < least_rows:
        found.append(("min_rows", "", float(n), "warning"))
    found += [("missing_column", s.name, 1.0, "error") for s in specs if s.required and s.name not in df.columns]
    for i, s in enumerate(there) if n else ():
        filled, first = row[f"c{i}"], row[f"v{i}_0"]
        if 1 - filled / n > most_null:
            found.append(("high_null_rate", s.name, 1 - filled / n, "warning"))
        if s.kind in ("number", "time") and not first:
            if s.required:
                found.append(("dtype_coerce_failed", s.name, 0.0, "warning"))
        elif s.kind == "number":
            low, high = row[f"v{i}_1"], row[f"v{i}_2"]
            found += [("range_violation", s.name, x, "warning") for x, bad in ((low, s.low is not None and low < s.low), (high, s.high is not None and high > s.high)) if bad]
        elif s.kind == "text" and filled and first / filled > most_null:
            found.append(("high_empty_string_rate", s.name, first / filled, "warning"))
        elif s.kind in ("flag", "json") and filled and first / filled < (0.95 if s.kind == "flag" else 0.7):
            found.append(("dtype_coerce_failed", s.name, first / filled, "warning"))
    found += [("invalid_values", c, float(row[f"a{k}"]), "error") for k, c in enumerate(outside) if row[f"a{k}"]]
    if n and keys and set(keys) <= set(df.columns):
        again = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
        found += [("duplicate_keys", "|".join(keys), float(again), "error")] if again else []
    late, hints = [c for c in df.columns if c.endswith(("_post", "_final"))], [c for c in df.columns if any(w in c.lower() for w in HINTS)]
    found += [(code, "|".join(sorted(names)), float(len(names)), "warning") for code, names in (("leakage_columns", late), ("leakage_token_hits", hints)) if names]
    if not n:
        found = [("empty_df", "", 0.0, "error")]
    return df.sparkSession.createDataFrame(found, "code string, column string, value double, severity string")
