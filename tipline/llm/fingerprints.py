"""Bottom-k fingerprints of word-shingle hashes, in built-in expressions only.

A text's fingerprint is the k smallest distinct hashes of its five-word shingles (of the whole word sequence where there are
fewer words). Fingerprints of parts merge into that of the whole; two of them estimate resemblance and containment, and one
estimates the number of distinct shingles. Estimates are exact while a text has at most k shingles.

Defined results: null text is empty text; a text without words has the empty fingerprint; two empty fingerprints resemble
each other with 1, an empty and another with 0. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipline.llm.common import SPACE, staged, text_of

#: Hashes kept, words in a shingle, bits of a hash.
K, WORDS, BITS = 128, 5, 63
#: Characters of text in a range of documents that one task works on, as long as there are fewer than MOST_RANGES of them.
RANGE_CHARS, MOST_RANGES = 1 << 24, 1 << 16


def add_words(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, F.filter(F.split(F.col(text), f"{SPACE}+"), lambda w: w != ""))


def add_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """Adds the sorted bottom-k hashes of a text column as array<bigint>."""
    df = add_words(df, text, "_words")
    n = F.size("_words")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))))
    # The column is used twice, so the optimiser keeps the split words as a column instead of splitting for each shingle.
    hashes = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(F.col("_words"), i, words)), 64 - BITS))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the two shingle sets."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(2.0**BITS) / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), -(-BITS // 4), "0")), "")


def _first_keys(keys: DataFrame) -> list:
    """The first key (column o) of each of the ranges that the rows are dealt to, in order; their number has a bound."""
    size = keys.agg(F.sum("n_chars")).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-size // RANGE_CHARS)))
    firsts = keys.select("o").repartitionByRange(ranges, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("o"))
    return [r.o for r in firsts.orderBy("o").collect()]


def _range_of(o: Column, firsts: Column) -> Column:
    """Number of the range that a key lies in: binary search in the ranges' first keys."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_RANGES.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(firsts, at + step) <= o, at + step).otherwise(at))


def fingerprint_edits(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next document's, in
    descending doc_id (null last, ties by a hash of the text); the last document's next one is the first. Rows that repeat id and text have the
    same next document: the next different one. Texts are shuffled once, to the range of keys they lie in; the first document of a
    range goes to the range before it, too."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    doc_id = F.col("doc_id")
    o = F.struct(doc_id.isNull().alias("none"), F.bitwise_not(F.coalesce(doc_id, F.lit(0).cast("long"))).alias("id"), F.bitwise_not(F.xxhash64("text")).alias("h"))
    firsts = _first_keys(staged(text.select(o.alias("o"), F.char_length("text").cast("long").alias("n_chars"))))
    table = docs.sparkSession.createDataFrame([(1, firsts)], "one int, firsts array<struct<none:boolean,id:bigint,h:bigint>>")
    rows = text.withColumn("o", o).withColumn("one", F.lit(1)).join(F.broadcast(table), "one")
    rows = rows.withColumn("range", _range_of(F.col("o"), F.col("firsts")))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("lent"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, len(firsts)))).alias("range"), F.lit(True).alias("lent"))
    places = F.when(F.get("firsts", F.col("range")) == F.col("o"), F.array(own, before)).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", "o", F.explode(places).alias("place")).select("doc_id", "text", "o", "place.range", "place.lent")
    once = rows.repartition("range").groupBy("range", "lent", "o").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    once = add_sketch(once, "text", "sketch", k)
    following = Window.partitionBy("range").orderBy("lent", "o")
    pairs = once.select("*", F.lead("text").over(following).alias("next_text"), F.lead("sketch").over(following).alias("next_sketch")).where("NOT lent")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select(
        "doc_id", "copies", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "sketch", "next_sketch"
    )
    done = add_sketch(edited, "edited", "edited_sketch", k).select(
        "doc_id",
        "copies",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
    return done.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copy", "copies")
