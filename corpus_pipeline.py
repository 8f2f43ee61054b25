"""A corpus pipeline of five stages: language ID, line dedup, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
Every stage but the last returns the columns of documents. Rows may repeat ids, and any column may hold nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.llm import language_id, line_dedup, mixing, ngram_join, packing
from tipline.llm.common import documents, dropped, noting, staged, unread
from tipline.llm.queries import word_tokenizer

#: Share of a document's letter n-grams that its language must have, as a part of what the language's own documents reach; below it, the text is in no learned language.
LEAST_KNOWN = 0.2


#: Tables that the stage before staged.
_before: list[DataFrame] = []


def _begin(docs: DataFrame) -> None:
    """A stage begins when the result of the one before is written: what that one staged is deleted, unless docs still reads it."""
    done = unread(_before, docs)
    dropped(*done)
    _before[:] = [t for t in _before if not any(t is d for d in done)]


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _begin(docs)
        with noting(_before):
            return f(spark, docs, sf_dir)

    return begun


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Those without a letter, or with n-grams of which their language has too few, go; texts too short to have any stay."""
    model = language_id.learned(docs)
    named = language_id.identify(docs, model, F.col("text"), F.struct("*"))
    if model is None:
        return named.where("false").select("keep.*")
    least = F.create_map(*[F.lit(x) for pair in zip(model.languages, (LEAST_KNOWN * model.reach).tolist(), strict=True) for x in pair])
    return named.where((F.col("lang_pred") != "und") & ((F.col("n_grams") == 0) | (F.col("known") >= least[F.col("lang_pred")]))).select("keep.*")


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, of any length, that an earlier document, or an earlier place, has; those of which nothing is left go."""
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    values = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))}
    return left.select([values.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    """row (a number of its own for each row) and doc (all columns): whatever the columns are called, nothing clashes."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents (null last); documents without links stay, and so do those without words."""
    rows = _numbered(docs)
    groups = ngram_join.join(rows.select("row", "doc.text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.struct(F.col("doc.doc_id").isNull().alias("none"), "doc.doc_id", "row").alias("place"))
    kept = groups.join(ids, "row").groupBy("component_id").agg(F.min("place").alias("place")).select("place.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times. Documents without words add nothing to it and go."""
    rows = _numbered(docs)
    taken = mixing.mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), row_col="row").where("taken > 0").select("row", F.expr("cast(taken div size as int)").alias("copies"))
    return rows.join(taken, "row").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence."""
    _begin(docs)
    return packing.pack(docs, word_tokenizer())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL can express neither the language filter nor the search for a packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
