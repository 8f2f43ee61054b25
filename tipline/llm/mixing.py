"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a word target by weight. A document's place is a 60-bit hash of its id and text. Words are summed by source and
hash bucket; the running sum shows the bucket in which the source's budget runs out, and only that bucket is cut into finer
ones, 12 bits at a time, until it holds one hash value. Everything below the threshold is taken: a filter, no sort. Of rows that repeat id and text,
and so share the boundary hash, as many are taken as fit.
Budgets are nested: a larger budget takes all that a smaller one takes, and whole epochs come before a partial one.

Defined results: null text has size 0; a null source is a source of its own, last in order; a null id counts as empty text in the
hash; empty tables give empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipline.llm.common import WORD, sized, staged, text_of

#: Bits of the hash, and how many each refinement looks at.
HASH_BITS, STEP = 60, 12


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """row_col where given, doc_id, place (hash of id and text), key (source, with null as a value of its own that sorts last) and size in words."""
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text_of(text_col))
    hashed = F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10)
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source_col).cast("string")))
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    row = [F.col(row_col)] if row_col else []
    return docs.select(*row, F.col(id_col).alias("doc_id"), hashed.cast("long").alias("place"), key.alias("key"), size.alias("size"))


def targets(by_source: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """key, source_size, target. by_source has one row per source: key, source_size."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1).cast("int"))
    everyone = Window.partitionBy(F.lit(1))
    fill = Window.orderBy(F.col("most") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all_words") * share - F.coalesce(F.sum("most").over(fill), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    levels = (
        by_source.withColumn("w", w)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("all_words", F.sum("source_size").over(everyone))
        .withColumn("all_w", F.sum("w").over(everyone))
        .withColumn("level", level)
        .withColumn("full", F.col("most") / F.col("w") <= F.col("level"))
    )
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everyone)  # the first source below its cap has the highest level
    return levels.withColumn("common", common).select(
        "key", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * F.col("common")).alias("target")
    )


def thresholds(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, epochs (whole passes), last (the boundary hash), rows that have it and how many of them are taken. wanted: from targets()."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = wanted.withColumn("epochs", epochs.cast("long"))
    budget = budget.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn("lo", F.lit(0).cast("long"))
    found, open_ = None, budget.select("key", "epochs", "left", "lo")
    for used in range(STEP, HASH_BITS + 1, STEP):
        shift = HASH_BITS - used
        at = F.shiftright("place", shift)
        inside = base.where("size > 0").join(sized(open_), "key").where(F.shiftright("place", shift + STEP) == F.col("lo"))
        measures = [F.sum("size").alias("words"), F.min("place").alias("least"), F.max("place").alias("most"), F.count("*").alias("rows"), F.max("size").alias("one")]
        bins = inside.groupBy("key", "epochs", "left", at.alias("bin")).agg(*measures)
        run = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        edge = bins.withColumn("upto", F.sum("words").over(run)).where("upto - words <= left AND left < upto")
        edge = staged(edge.withColumn("left", F.col("left") - (F.col("upto") - F.col("words"))))
        fit = F.floor(F.col("left") / F.col("one")).cast("long")  # equal texts, one size
        fit = fit + ((F.col("left") - fit * F.col("one")) * 2 >= F.col("one")).cast("long")
        settled = edge.where("least = most").select("key", "epochs", F.col("least").alias("last"), "rows", F.least("rows", fit).alias("fit"))
        found = settled if found is None else found.unionByName(settled)
        open_ = edge.where("least < most").select("key", "epochs", "left", F.col("bin").alias("lo"))
        if open_.isEmpty():
            break
    return found


def first_rows(base: DataFrame, edges: DataFrame) -> DataFrame:
    """rid of the rows with a boundary hash that are taken although others with it are not. Rows are numbered by part of the staged table, so that no part waits for another."""
    some = edges.where("fit > 0 AND fit < rows").select("key", F.col("last").alias("place"), "fit")
    ties = base.where("size > 0").select("rid", "key", "place").join(sized(some), ["key", "place"]).withColumn("part", F.shiftright("rid", 33))
    counts = ties.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("rid"))
    return ties.withColumn("number", number).join(counts, ["key", "part"]).where("before + number <= fit").select("rid", F.lit(True).alias("chosen"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: row_col where given, doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    base = staged(sizes(docs, id_col, text_col, source_col, row_col).withColumn("rid", F.monotonically_increasing_id()))
    wanted = staged(targets(base.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, cap))
    edges = staged(thresholds(base, wanted))
    chosen = staged(first_rows(base, edges))
    plan = staged(wanted.join(edges, "key", "left"))
    here = F.col("place") == F.col("last")
    once = F.coalesce((F.col("place") < F.col("last")) | (here & (F.col("fit") >= F.col("rows"))) | (here & F.col("chosen")), F.lit(False))
    epochs = F.coalesce(F.col("epochs"), F.lit(0).cast("long"))
    rows = base.join(sized(plan), "key").join(sized(chosen), "rid", "left")
    return rows.select(*[row_col] * bool(row_col), "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * (epochs + once.cast("long"))).alias("taken"))
