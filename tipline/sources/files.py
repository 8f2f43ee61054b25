"""Reading and writing tables of files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipline.operators.joins import append_best


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first of the paths that exists, by the declared schema; an empty table if there is none."""
    for path in paths:
        if exists(spark, path):
            return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return spark.createDataFrame([], schema)


def read_json_folder(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an order; it must decide every tie for the result to be the same each time."""
    return df.orderBy(*order).limit(n)


def report(df: DataFrame, path: str, kind: str) -> None:
    """A small result as one file of JSON lines or of CSV with a header; null is an empty field."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.csv(path, header=True)


def read_report(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.json(path) if kind == "json" else reader.csv(path, header=True)


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of the pages' tables: key, row (from 0) and the cells' text."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " ")))
    return pages.select(key, F.posexplode(rows).alias("row", "_row")).select(key, "row", cells.alias("cells"))


#: File beside a table's versions that names the one to read; Spark's readers skip names with an underscore.
POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    """Name of the table's current version."""
    p, fs = _hadoop(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def table(spark: SparkSession, path: str, schema: T.StructType | None = None, part: str = "") -> DataFrame | None:
    """The current version of a table that replace() wrote, or of a part that replace_all() wrote; an empty table, or None without a schema, where there is none yet."""
    path = path.rstrip("/")
    name = _current(spark, path)
    if name is None:
        return None if schema is None else spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{name}/{part}".rstrip("/"))


def replace(df: DataFrame, path: str, **options) -> None:
    """Writes a new version of the table, then names it in one rename of the pointer: at any moment readers find the old or the new table, a failure leaves
    the old one, and a table may be rewritten from itself. The version before stays for readers that have begun; older ones go."""
    replace_all({"": df}, path, **options)


def replace_all(tables: dict[str, DataFrame], path: str, **options) -> None:
    """replace() for several tables that change together, each in a folder of the version named after it: readers find all of them old or all new."""
    spark, path = next(iter(tables.values())).sparkSession, path.rstrip("/")
    name = f"v-{uuid.uuid4().hex}"
    for part, df in tables.items():
        df.write.options(**options).parquet(f"{path}/{name}/{part}".rstrip("/"))
    _point(spark, path, name)


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Makes a version the current one and deletes all but this and the one before."""
    at, fs = _hadoop(spark, path)
    before = _current(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, pointer = hadoop.Path(f"{path}/_{name}"), hadoop.Path(f"{path}/{POINTER}")
    out = fs.create(new)
    out.write(bytearray(name.encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    rename[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, pointer, rename)
    for f in fs.listStatus(at):
        old = f.getPath()
        if old.getName().startswith("v-") and old.getName() not in (name, before):
            fs.delete(old, True)


def append(new: DataFrame, path: str, keys: list[str], score: Column, recent: str, tie: list[str]) -> DataFrame:
    """Adds rows to the table at path; of one key, the most complete and then most recent row stays. Returns the table."""
    spark = new.sparkSession
    replace(append_best(table(spark, path, new.schema), new, keys, score, recent, tie), path)
    return table(spark, path)


def archive(df: DataFrame, path: str, day: str, source: str) -> None:
    """Rows as JSON with an envelope (source, number of columns), in folders by year and month of a day column."""
    row = F.struct(F.lit(source).alias("source"), F.lit(len(df.columns)).alias("n_fields"), F.struct("*").alias("data"))
    df.select(row.alias("r"), F.year(day).alias("year"), F.month(day).alias("month")).select("r.*", "year", "month").write.partitionBy("year", "month").mode("append").json(path)


def not_html(spark: SparkSession, path: str) -> bool:
    """Whether a file's first line with text looks like data, not like the page that a site sends to robots."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    return head is not None and not head[0].lstrip().lower().startswith(("<!doctype", "<html", "<head", "<body"))


def ddl(schema: T.StructType, table: str, key_names: tuple[str, ...] = ("row_hash", "id", "game_id")) -> str:
    """A CREATE TABLE statement; the first of the key names that is there becomes the primary key."""
    key = next((k for k in key_names if k in schema.names), None)
    columns = ", ".join(f'"{f.name}" {f.dataType.simpleString()}' for f in schema)
    return f'CREATE TABLE "{table}" ({columns}' + (f', PRIMARY KEY ("{key}"))' if key else ")")
