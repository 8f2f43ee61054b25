import re

from pyspark.sql import functions as F

from tipline.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def fill(sizes: list[int], weights=(3, 1, 2), share=1.5, cap=2.0) -> list[float]:
    """Targets by repeated resharing."""
    w = [weights[i % 3] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        level = left / sum(w[i] for i in open_)
        above = {i for i in open_ if w[i] * level > cap * sizes[i]}
        if not above:
            for i in open_:
                out[i] = w[i] * level
            break
        for i in above:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= above
    return out


def test_against_brute_force(spark, sf_dir):
    extra = [(9001, None, "src0", ""), (9002, "one two", None, ""), (9003, "a b c", None, ""), (9003, "a b c", None, ""), (None, "x y", "zz", ""), (9005, "", "only empty", "")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "source", "lang as target").union(spark.createDataFrame(extra, SCHEMA))
    got = mixing.mix(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, size(r.text)) for r in rows)
    source = {r.doc_id: r.source for r in rows}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(size(r.text) for r in rows if r.source == n) for n in names]
    for n, total, target in zip(names, totals, fill(totals), strict=True):
        mine = [r for r in got if source[r.doc_id] == n]
        assert all(r.source_size == total and abs(r.target - target) < 1e-4 for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_repeated_and_null_ids_come_near_their_targets(spark):
    rows = [(None, f"a b c d e {i}", "nulls", "") for i in range(500)] + [(7, "same text here", "repeats", "") for _ in range(700)]
    rows += [(8 + i % 2, "one two", "two ids", "") for i in range(300)] + [(100 + i, "w " * (i % 9), "plain", "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs.withColumn("r", F.monotonically_increasing_id()), row_col="r").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r)
    for target, mine in by.items():
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)


def test_budgets_are_nested_and_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = {r.doc_id: r.taken for r in mixing.mix(docs, share=0.4).collect()}
    large = {r.doc_id: r.taken for r in mixing.mix(docs, share=0.5).collect()}
    assert sum(small[i] > large[i] for i in small) <= 1
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
