import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tipline.llm import fill_in_middle
from tipline.llm.fill_in_middle import Bits, bitvectors

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text) -> tuple:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["", None, "a", "é", "日本語 text", "a\nb\r\n\x00c", "<P>", "x <S> y", "< P><", "<", "ends in <", "<P <S <M", "🦆🦆", "word " * 30_000, "x" * 200_000, "é" * 70_000, "A1b2" * 9]


@pytest.mark.parametrize("step", [1 << 20, 8])
def test_against_brute_force(spark, sf_dir, step, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "STEP", step)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang as output", "source as h1")
    odd = [(10_000 + i if i % 9 else None, t, "clash", "clash") for i, t in enumerate(ODD * 6)] + [(7, "same", "", "")] * 3
    if step == 8:  # the small step is for the bounds of steps, not for many texts
        docs = docs.limit(40)
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    kept = docs.collect()
    want = sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in kept), key=repr)
    rows = fill_in_middle.transform(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr) == want
    assert sorted((r.doc_id is None, r.doc_id or 0, r.back) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@given(st.lists(st.booleans(), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(bits):
    ones = np.flatnonzero(bits)
    packed = Bits(np.packbits(np.array(bits, bool), bitorder="little"), len(bits))
    at = np.arange(len(bits) + 1)
    assert packed.rank(at).tolist() == np.concatenate([[0], np.cumsum(bits)]).astype(int).tolist()
    assert packed.select(np.arange(len(ones))).tolist() == ones.tolist()


@given(st.lists(st.text(alphabet=st.sampled_from("aB1 é日🦆<PSM>\n"), max_size=40), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_tokens_of_any_text(texts):
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    tokens, points = bitvectors(np.frombuffer(b"".join(raw), np.uint8), starts[:-1][starts[:-1] < starts[-1]])
    assert np.diff(tokens.rank(starts)).tolist() == [len(TOKEN.findall(t)) for t in texts]
    assert np.diff(points.rank(starts)).tolist() == [len(t) for t in texts]
    got = fill_in_middle._parts(pa.array(texts), np.array([[3, 8, 1, 50]] * len(texts), np.int64))
    assert all((a == t) == (f == "plain") for a, t, f in zip(got["output"].to_pylist(), texts, got["form"].to_pylist(), strict=True))
