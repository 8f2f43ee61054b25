import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from tipline.llm import exact_dedup

SCHEMA = "doc_id long, text string, key string, kept string"


@pytest.mark.parametrize(("bits", "bucket_keys"), [(63, 65_536), (63, 4), (3, 4), (1, 1)])
def test_against_brute_force(spark, sf_dir, bits, bucket_keys):
    extra = [(9001, None, "k", ""), (9002, "", "k", ""), (9003, " \n", "k", ""), (9004, "a b", "k", ""), (9005, "ab ", "k", ""), (9006, "a b", "k", ""), (9007, "x" * 300_000, "k", ""), (9007, "x" * 300_000, "k", ""), (None, "a  b", "k", "")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "source as key", "lang as kept").union(spark.createDataFrame(extra, SCHEMA))
    groups = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for i, t in rows:
        groups[hashlib.sha256(t.encode().translate(None, b" \t\n\x0b\x0c\r")).hexdigest()].append((-len(t), i is None, i))
    want = []
    for sha, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        want += [(m[2], members[0][2], len(members), k == 0, sha) for k, m in enumerate(members)]
    got = [tuple(r) for r in exact_dedup.exact_groups(docs, bits=bits, bucket_keys=bucket_keys).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_come_from_the_index(spark, monkeypatch):
    rows = [(i, "same text" if i % 3 else f"other {i % 30}", "", "") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 200)  # many entries of one text
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, bits=2).collect()}
    assert got[5].group_size == 2000 and got[5].keep_id == 1 and got[3].group_size == 100 and got[3].keep_id == 3
    assert sum(r.kept for r in got.values()) == 11

    def apart(batches):  # without the chain's comparison every entry is a class of its own
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(1), b.column(2), b.column(5)], names=["entry", "keep_entry", "keep_id", "group_size"])

    monkeypatch.setattr(exact_dedup, "_chained", apart)
    assert sum(r.kept for r in exact_dedup.exact_groups(docs, bits=2).collect()) > 11
