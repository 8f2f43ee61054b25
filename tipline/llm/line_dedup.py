"""Line deduplication by a deletion-neighbourhood join, in built-in expressions only.

A line counts by its words, lower-cased. It is dropped when the same line, or one within an edit distance of one word (a word
replaced, added or missing), occurs earlier: in a smaller doc_id, or before it in the same document. The edit bound is a tenth of the line's
words, at most one: lines of fewer than near_words words only go when an equal line is earlier. Every line with a word is compared, whatever
its length (min_words is 1; lines with fewer always stay). With unspaced, each letter of a script that is written without spaces is a word, and
white space beside it does not count.

Equal lines collapse first, so that frequent lines are one row each. Only lines that share an intact half with another line can
be within the bound (one edit leaves the first or the last half alone); for these, all variants are emitted as hashed keys:
the line without its i-th word, and the line with room for one at i. Lines with equal variants are within the bound; each is held
against the earliest of its variant's group only, so a group of any size costs one row per member, and the words of the two
are compared at the end.

Defined results: null text stays null; lines are separated by line feeds; rows without an id come last; repeated rows (same id
and text) are one document, kept or shortened alike; all other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipline.llm.common import SPACE, sized, staged, text_of

#: Words from which a line is compared at all, and from which an edit of one word is tolerated.
MIN_WORDS, NEAR_WORDS = 1, 10
#: Letters of scripts that put no spaces between words, and the ranges they lie in: a range is told at once, where a script takes a look-up for each letter.
RANGES = r"\x{0E00}-\x{19FF}\x{2E80}-\x{10FFFF}"
UNSPACED_RANGES = f"[{RANGES}]"
UNSPACED = rf"[{RANGES}&&[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\x{{30FC}}\p{{IsThai}}\p{{IsLao}}\p{{IsKhmer}}\p{{IsMyanmar}}\p{{IsTibetan}}]]"
#: Rows of two or three numbers up to which the lines to look at again are broadcast.
SMALL = 400_000
#: Words up to which a line's variants are hashed from its text; longer ones use running sums.
LONG = 2_000


def _low(line: Column, unspaced: bool) -> Column:
    """The line in lower case; with unspaced, with spaces around each letter of a script without them."""
    low = F.lower(line)
    if not unspaced:
        return low
    apart = (F.octet_length(line) > F.char_length(line)) & line.rlike(UNSPACED_RANGES)
    return F.when(apart, F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)


def _normal(low: Column) -> Column:
    """The words of a line in lower case, with one space between them."""
    odd = F.contains(low, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(low, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(low, f"{SPACE}+", " ")).otherwise(low))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, unspaced: bool) -> DataFrame:
    """place (sorts by document), line_no, norm, n (words), a and b (together the line's 128-bit hash)."""
    text = docs.select(_place(id_col, text_col).alias("place"), text_of(text_col).alias("text"))
    lines = text.select("place", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    # Generators of one row: what follows does not repeat the work before it.
    lines = lines.select("place", "line_no", F.explode_outer(F.array(_low(F.col("line"), unspaced))).alias("low"))
    lines = lines.select("place", "line_no", F.explode_outer(F.array(_normal(F.col("low")))).alias("norm"))
    n = F.octet_length("norm") - F.octet_length(F.replace(F.col("norm"), F.lit(" "))) + F.lit(1)
    lines = lines.withColumn("n", F.when(F.col("norm") == "", F.lit(0)).otherwise(n)).where(F.col("n") >= min_words)
    return lines.withColumn("a", F.xxhash64("norm")).withColumn("b", F.xxhash64(F.lit("b"), "norm"))


def _first(h: Column) -> Column:
    return F.call_function("substring_index", F.col("norm"), F.lit(" "), h)


def _last(h: Column) -> Column:
    return F.call_function("substring_index", F.col("norm"), F.lit(" "), -h)


def _place(id_col: str, text_col: str) -> Column:
    identity = F.col(id_col).cast("long")
    return F.struct(identity.isNull().alias("none"), F.coalesce(identity, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))


def _halves(near_words: int) -> Column:
    """Hashes of the first and last h words, for the h of a partner of n - 1 and of n or more words; last says which."""
    n, pairs = F.col("n"), []
    for less in (1, 2):
        h = F.shiftright(n - less, 1)
        pairs.append([F.struct(F.xxhash64(F.lit(name), h, words(h)).alias("half"), F.lit(name == "last").alias("last")) for name, words in (("first", _first), ("last", _last))])
    # Both are the same h if n is even.
    return F.when(n < near_words, F.array().cast("array<struct<half:bigint,last:boolean>>")).when(n % 2 == 0, F.array(*pairs[0])).otherwise(F.array(*pairs[0], *pairs[1]))


def _variants(lines: DataFrame) -> DataFrame:
    """line, key: the line without its i-th word, and the line with room for a word at i; key hashes i and the words before and after.
    Where only a first half is shared, i lies behind it; where only a last one is, before it."""
    h = F.shiftright(F.col("n") - 2, 1)
    spots = F.sequence(F.when(F.col("last"), F.lit(1)).otherwise(h + 1), F.when(F.col("first_too"), F.col("n") + 1).otherwise(F.col("n") - h + 1))
    short = lines.where(F.col("n") <= LONG + 1).select("line", "norm", "n", F.explode(spots).alias("i"))
    n, i = F.col("n"), F.col("i")
    before, after = F.xxhash64(_first(i - 1)), F.xxhash64(_last(n - i + 1))
    without = F.when(i <= n, F.xxhash64(i, before, F.xxhash64(_last(n - i))))
    short = short.select("line", F.explode(F.array_compact(F.array(without, F.xxhash64(i, before, after)))).alias("key"))
    # Lines too long to hash once per word: sums of position-bound word hashes stand for the words before and after.
    words = lines.where(F.col("n") >= LONG).select("line", "n", F.posexplode(F.split("norm", " ")).alias("j", "word"))
    words = words.withColumn("f", F.shiftright(F.xxhash64("word", "j"), 24)).withColumn("g", F.shiftright(F.xxhash64("word", F.col("n") - F.col("j"), F.lit("g")), 24))
    part = Window.partitionBy("line")
    upto = part.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    words = words.select("line", "n", F.col("j").alias("i"), "f", "g", F.coalesce(F.sum("f").over(upto), zero).alias("sf"), (F.sum("g").over(part) - F.coalesce(F.sum("g").over(upto), zero)).alias("sg"))
    end = F.when(F.col("i") == F.col("n") - 1, F.xxhash64("n", F.col("sf") + F.col("f"), zero))
    keys = F.array(F.xxhash64("i", "sf", F.col("sg") - F.col("g")), F.xxhash64("i", "sf", "sg"), end)
    return short.unionByName(words.select("line", F.explode(F.array_compact(keys)).alias("key")))


def _within_one(x: Column, y: Column) -> Column:
    """Edit distance of two word arrays is at most one word."""

    def common(p: Column, q: Column) -> Column:
        first = F.array_position(F.zip_with(p, q, lambda v, w: v.eqNullSafe(w)), F.lit(False))
        return F.when(first == 0, F.least(F.size(p), F.size(q))).otherwise(first - 1)

    longest = F.greatest(F.size(x), F.size(y))
    return (F.abs(F.size(x) - F.size(y)) <= 1) & (common(x, y) + common(F.reverse(x), F.reverse(y)) >= longest - 1)


def near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, near_words: int, unspaced: bool = False) -> DataFrame:
    """a, b of lines that have an earlier line within one word. distinct: a, b, first, halves of each distinct line."""
    halves = distinct.select("a", "b", "first", F.inline("halves"))
    shared = halves.groupBy("half").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high").select("half")
    some = staged(halves.join(shared, "half").groupBy("a", "b", "first").agg(F.bool_or("last").alias("last"), F.bool_or(~F.col("last")).alias("first_too")))
    again = _lines(docs, id_col, text_col, near_words, unspaced)
    found = again.join(sized(some, SMALL), ["a", "b"]).where("place = first.place AND line_no = first.line_no")
    lines = found.groupBy("a", "b", "first", "n", "last", "first_too").agg(F.first("norm").alias("norm"))
    lines = staged(lines.withColumn("line", F.monotonically_increasing_id()))
    variants = staged(_variants(lines))
    shared = variants.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high").select("key")
    met = staged(variants.join(shared, "key").join(lines.select("line", "first"), "line"))
    heads = met.groupBy("key").agg(F.min(F.struct("first", "line")).alias("head"))
    pairs = met.join(heads, "key").where("first > head.first").select("line", F.col("head.line").alias("other")).distinct()
    theirs = lines.select(F.col("line").alias("other"), F.split("norm", " ").alias("earlier"))
    checked = pairs.join(lines.select("line", "a", "b", F.split("norm", " ").alias("words")), "line").join(theirs, "other")
    return staged(checked.where(_within_one(F.col("words"), F.col("earlier"))).select("a", "b").distinct())


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text", unspaced: bool = True) -> DataFrame:
    """row (a struct of all input columns), text without the dropped lines, n_lines and n_dropped."""
    occurrence = F.struct("place", "line_no").alias("at")
    lines = staged(_lines(docs, id_col, text_col, min_words, unspaced).select(occurrence, "a", "b", _halves(near_words).alias("halves")))
    grouped = lines.groupBy("a", "b").agg(F.min("at").alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves"))
    distinct = staged(grouped)
    near = near_lines(docs, distinct, id_col, text_col, near_words, unspaced).withColumn("near", F.lit(True))
    gone = distinct.join(near, ["a", "b"], "left").where("times > 1 OR near").select("a", "b", "first", "near")
    dropped = lines.drop("halves").join(gone, ["a", "b"]).where("near OR at > first").select("at.place", "at.line_no")
    dropped = dropped.groupBy("place").agg(F.collect_set("line_no").alias("dropped"))  # bounded by the lines of a document
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"), _place(id_col, text_col).alias("place"))
    rows = rows.join(dropped.hint("shuffle_hash"), "place", "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains("dropped", i))
    return rows.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
