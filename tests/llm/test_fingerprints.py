import hashlib

import pytest
from pyspark.sql import functions as F

from tipline.llm import fingerprints

SCHEMA = "doc_id long, text string, fingerprint string"


def shingles(text: str) -> set:
    words = [w for w in text.encode().split() if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("range_chars", [1 << 24, 4000])
def test_against_brute_force(spark, sf_dir, range_chars, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", range_chars)  # one range, and many
    extra = [(9001, None, ""), (9002, "", ""), (9003, "one two", ""), (9004, "ein Wort, ééé 日本 " * 40, ""), (9005, "w" * 50_000 + " x", ""), (9006, "same", ""), (9006, "same", ""), (None, "null id", "")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang as fingerprint").union(spark.createDataFrame(extra, SCHEMA))
    rows = sorted({(r.doc_id is None, -(r.doc_id or 0), r.text or "") for r in docs.collect()})
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.n_chars): r for r in got}
    prints = {}
    for k, (none, i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        r = by[(None if none else -i, n)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = shingles(text), shingles(edited), shingles(following)
        for true, estimate in ((jaccard(a, e), r.near_edited), (jaccard(a, b), r.near_next)):
            assert abs(true - estimate) < (0.2 if max(len(a), len(e), len(b)) > 60 else 1e-9)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint


def test_merge_count_containment(spark):
    words = [f"w{i}" for i in range(3000)]
    one, two = " ".join(words[:2000]), " ".join(words[996:])
    df = spark.createDataFrame([(one, two, " ".join(words))], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.add_sketch(df, c, f"s{c}", k=512)
    r = df.select(
        (fingerprints.merge(F.col("sa"), F.col("sb"), 512) == F.col("sc")).alias("same"),
        fingerprints.distinct_shingles(F.col("sa"), 512).alias("n"),
        fingerprints.containment(F.col("sa"), F.col("sc"), 512).alias("inside"),
        fingerprints.resemblance(F.col("sa"), F.col("sb"), 512).alias("j"),
    ).first()
    assert r.same and abs(r.n - 1996) < 300 and r.inside > 0.85 and abs(r.j - 1000 / 2996) < 0.1


def test_one_document_follows_itself(spark):
    r = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcde", "")] * 3, SCHEMA)).collect()
    assert len(r) == 3 and r[0].edited_sha256 == hashlib.sha256(b"abcab").hexdigest() and r[0].near_next == 1.0


def test_empty(spark):
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
