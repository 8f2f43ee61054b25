import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tipline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, sequence_id string"


def test_pieces_and_sequences(spark, sf_dir):
    extra = [(9001, None, "x"), (9002, "", "x"), (9003, "wide space İı ſ é <|endoftext|> don't \x1c a", "x"), (9004, "long " * 9000, "x"), (9004, "long " * 9000, "x"), (None, "no id", "x")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "source as sequence_id").union(spark.createDataFrame(extra, SCHEMA))
    got = packing.pack(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, 2048 * k, len(p := ids[2048 * k : 2048 * (k + 1)]), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 2048))]
    key = lambda x: (x[0] is None, x)
    assert sorted([tuple(r)[:5] for r in got], key=lambda x: (x[0] or -1, x[1:])) == sorted(want, key=lambda x: (x[0] or -1, x[1:]))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.02 * (sum(r.length for r in got) / 2048) + 2


def least_bins(sizes: list[int], length: int) -> int:
    """The optimum by trying every bin for each piece."""
    best = [len(sizes)]

    def place(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= length and bins[b] not in bins[:b]:
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def _steps(bins: list[list[int]], sizes: list[int], length: int) -> bool:
    """Whether any move or exchange of at most two for one still raises the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    for low, b in enumerate(bins):
        gives = [(i,) for i in b] + [(i, j) for k, i in enumerate(b) for j in b[:k]]
        for full, c in enumerate(bins):
            takes = [()] + [(i,) for i in c] + [(i, j) for k, i in enumerate(c) for j in c[:k]]
            for g in gives:
                for t in takes:
                    gain = sum(sizes[i] for i in g) - sum(sizes[i] for i in t)
                    if low != full and fill[full] >= fill[low] and len(g) + len(t) < 4 and 0 < gain <= length - fill[full]:
                        return True
    return False


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), max_size=9))
def test_few_pieces_need_the_optimum_or_one_bin_more(sizes):
    bins = packing.improve(packing.best_fit(sizes, 40), sizes, 40)
    assert len(bins) <= least_bins(sizes, 40) + 1
    assert len(bins) == -(-sum(sizes) // 40) or not _steps(bins, sizes, 40)


def test_search_ends_where_no_step_is_left():
    rng = random.Random(4)
    for low, high in ((30, 70), (25, 40), (10, 60)):
        sizes = [rng.randint(low, high) for _ in range(150)]
        start = packing.best_fit(sizes, 100)
        bins = packing.improve([list(b) for b in start], sizes, 100)
        assert len(bins) <= len(start)
        assert len(bins) == -(-sum(sizes) // 100) or not _steps(bins, sizes, 100)


def test_repeated_rows_and_leftovers_of_many_groups(spark):
    docs = spark.createDataFrame([(7, "one two three " * 30)] * 900 + [(None, "x y z " * 60)] * 900, "doc_id long, text string").repartition(5)
    one, many = (packing.pack(docs, PATH, group_pieces=n).collect() for n in (100_000, 60))
    assert len(one) == len(many) == 1800
    tokens = sum(r.length for r in one)
    for got in (one, many):
        fill = {}
        for r in got:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert max(fill.values()) <= 2048 and len(fill) <= 1.08 * tokens / 2048 + 2


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=12).map(lambda w: w + "."), max_size=8))
def test_ids_are_the_tokenizers(words):
    text = " ".join([*words, "BELEDİYESİ.", "GÜNLERİ,", "ΣΑΣ.", "ẋ,"])
    ids = np.array([*TOKENIZER.encode(text, add_special_tokens=False).ids, 0], "<u4")
    batch = next(packing._cutter(PATH, 1 << 20, 0)(iter([pa.record_batch({"doc_id": [1], "text": [text]})])))
    assert batch.column("length").to_pylist() == [len(ids)] and batch.column("ids_crc32").to_pylist() == [zlib.crc32(ids.tobytes())]


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_improve_keeps_every_piece(sizes):
    bins = packing.improve(packing.best_fit(sizes, 100), sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(packing.best_fit(sizes, 100))


def test_many_equal_pieces_are_searched_quickly():
    for sizes in ([30] * 12_000, [100] * 3000, [700] * 4000, [random.Random(k).randint(20, 40) for k in range(6000)]):
        start = packing.best_fit(sizes, 2048)
        began = time.time()
        bins = packing.improve([list(b) for b in start], sizes, 2048)
        assert len(bins) <= len(start) and time.time() - began < 20
