import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tipline.llm import vector_codes
from tipline.llm.vector_codes import Book, distances

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, rounds=4, entries=256) -> tuple[dict, list]:
    """Plain Python over (vec_id, embedding, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([-(-len(v) // 4) * 4 for _, v, _ in kept], default=0) or 4
    w = width // 4
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))  # rows that repeat an id: by their bytes
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(4)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((square(part, e), k) for k, e in enumerate(books[p])) for p, part in enumerate(cut(v))]
    for _ in range(rounds):
        found = [near(v) for _, v, _ in kept]
        for p in range(4):
            for k in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = near(v)
        error = sum(d for d, _ in found)
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
        by_label[label] = by_label.get(label, 0) + error
    return [(*r, by_label[r[1]]) for r in out], books


def compare(spark, rows, schema=SCHEMA, **more):
    table = spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(5)
    want, books = brute(rows, **more)
    done, got_books = vector_codes.compress(table, **more)
    got = [(r.vec_id, r.label, r.code, r.error, r.label_error) for r in vector_codes.with_label_error(done).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    assert vector_codes.digest(got_books) == hashlib.sha256(flat.encode()).hexdigest()


def test_against_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(size=8)], int(i) % 3 if i % 7 else None) for i in draw.permutation(90)]
    rows += [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] * 8, None), (1003, [float("inf")] * 8, 2), (-5, [0.5] * 8, 9)]
    rows += [(2, [0.25] * 8, 1), (2, [0.25] * 8, 1), (None, [0.125] * 8, None), *[(2000 + i, [0.75] * 8, 1) for i in range(40)]]
    compare(spark, rows, entries=12)
    compare(spark, rows)  # more entries than distinct rows: equal entries and entries that nothing uses
    compare(spark, rows, entries=5, rounds=0)


def test_ties_and_small_tables(spark):
    grid = [(i, [float(np.float32(((i * 7 + k * 3) % 4) / 1024)) for k in range(4)], None) for i in range(60)]
    compare(spark, grid, entries=6)
    compare(spark, grid[:1])
    compare(spark, [(1, None, 1)])
    compare(spark, [])
    compare(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [], 2), (3, [1.0] * 5, 2)])  # lengths that differ are filled up with zeros


def test_large_components(spark):
    draw = np.random.default_rng(2)
    compare(spark, [(int(i), [float(np.float32(x)) for x in draw.normal(size=8) * 50_000], 1) for i in range(70)], entries=9)
    done, _ = vector_codes.compress(spark.createDataFrame([(1, [3e38] * 8, 1, ""), (2, [-3e38] * 8, 1, ""), (3, [0.0] * 8, 1, "")], SCHEMA), entries=2)
    assert all(r.label_error >= r.error >= 0 for r in vector_codes.with_label_error(done).collect())


def test_many_labels_are_joined_by_salts(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "sized", lambda df: df)
    draw = np.random.default_rng(3)
    compare(spark, [(int(i), [float(np.float32(x)) for x in draw.normal(size=4)], None if i % 3 == 0 else int(i) % 20) for i in range(60)], entries=4)


def test_registered_query_on_the_table(spark, sf_dir):
    from tipline.llm import queries

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = brute(rows)
    got = queries.QUERIES["op11_vector_codes"](spark, sf_dir).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, t) for i, _, c, e, t in want)
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}


@given(st.integers(1, 200), st.integers(1, 256), st.integers(1, 6), st.sampled_from([3, 50, 2000, 20_000_000]), st.integers(0, 99))
@settings(max_examples=80, deadline=None)
def test_search_finds_the_nearest_from_any_start(n, k, width, spread, seed):
    draw = np.random.default_rng(seed)
    x, entries, start = draw.integers(-spread, spread + 1, (n, width)), draw.integers(-spread, spread + 1, (k, width)), draw.integers(0, k, n)
    d = ((x[:, None] - entries) ** 2).sum(2)
    index, distance = Book(entries).nearest(x, start)
    assert index.tolist() == d.argmin(1).tolist() and distance.tolist() == d.min(1).tolist()


@pytest.mark.parametrize("spread", [1000, 10**8])
def test_distances_are_exact(spread):
    draw = np.random.default_rng(4)
    x, y = draw.integers(-spread, spread, (50, 16)), draw.integers(-spread, spread, (40, 16))
    assert distances(x, y).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in y] for r in x]


def test_search_skips_what_cannot_be_nearer(monkeypatch):
    """Clusters far apart: only the first block of a list is looked at, whatever the number of entries."""
    draw = np.random.default_rng(5)
    entries = (np.arange(256) // 16)[:, None] * 100_000 + draw.integers(0, 50, (256, 4))
    x = entries[draw.integers(0, 256, 500)] + draw.integers(-5, 6, (500, 4))
    book, looked = Book(entries), []
    plain = vector_codes.distances
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    monkeypatch.setattr(vector_codes, "distances", lambda a, b: looked.append(len(a) * len(b)) or plain(a, b))
    start = ((x[:, None] - entries) ** 2).sum(2).argmin(1)
    index, _ = book.nearest(x, start)
    assert index.tolist() == start.tolist() and sum(looked) <= 500 * 16
