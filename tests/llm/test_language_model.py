import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tipline.llm import language_model

SCHEMA = "doc_id long, text string, score string"


def _tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0d]+", low) + [b" "]


def _held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_counts_and_base_score_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    count = Counter(t for i, x in rows.items() if not _held(i) for t in _tokens(x))
    n, v = sum(count.values()), len(count)
    for kwargs in ({}, {"bucket_tokens": 3000, "word_share": 2.0**-8, "pair_share": 2.0**-9}):  # one bucket, and many with frequent words
        got = language_model.score(docs, **kwargs).collect()
        assert len(got) == len(rows)
        for r in got:
            tokens = _tokens(rows[r.doc_id])
            assert (r.held_out, r.n_tokens, r.train_tokens) == (_held(r.doc_id), len(tokens), n)
            assert r.n_known == sum(count[t] > 0 for t in tokens)
            assert math.isclose(r.base_score, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), abs_tol=1e-6)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(i, "a b a c a b", None) for i in range(30)] + [(100 + i, w, None) for i, w in enumerate(["a", "b", "c", "zz"])]
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(rows, SCHEMA), folds=1000).collect()}
    # P(w | start) P(end | w): divide by P(end | w), known from two-word texts, is not needed; the first tokens alone must stay below 1 in sum.
    assert 0 < sum(10 ** got[100 + i] for i in range(4)) < 1


def plain_sampler(texts: list[str], discounts: tuple[float, float], theta: float, theta0: float, rounds: int, ask: list[tuple[bytes, bytes]], seed: int) -> list[float]:
    """P(word | context before) by a Gibbs sampler that moves one customer at a time, with every table kept."""
    rng = random.Random(seed)
    d, d0 = discounts
    vocabulary = len({t for x in texts for t in _tokens(x)})
    base = 1 / (vocabulary + 1)
    customers = [(u, w) for x in texts for u, w in zip([b""] + _tokens(x), _tokens(x))]
    seats = {}  # context -> word -> sizes of tables
    top = {}  # word -> sizes of tables of the parent

    def total(room):
        return sum(map(sum, room.values())), sum(map(len, room.values()))

    def parent(w):
        n, t = total(top)
        return (max(sum(top.get(w, [])) - d0 * len(top.get(w, [])), 0) + (theta0 + d0 * t) * base) / (theta0 + n)

    def prob(u, w):
        room = seats.get(u, {})
        n, t = total(room)
        return (sum(room.get(w, [])) - d * len(room.get(w, [])) + (theta + d * t) * parent(w)) / (theta + n)

    def sit(room, w, discount, fresh):
        tables = room.setdefault(w, [])
        x = rng.random() * (sum(tables) - discount * len(tables) + fresh)
        for k, n in enumerate(tables):
            x -= n - discount
            if x < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def leave(room, w):
        tables = room[w]
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    sums, kept = [0.0] * len(ask), 0
    for r in range(rounds):
        for u, w in customers:
            room = seats.setdefault(u, {})
            if r and leave(room, w):
                leave(top, w)
            if sit(room, w, d, (theta + d * total(room)[1]) * parent(w)):
                sit(top, w, d0, (theta0 + d0 * total(top)[1]) * base)
        if r >= 20:
            kept += 1
            for k, (u, w) in enumerate(ask):
                sums[k] += prob(u, w)
    return [x / kept for x in sums]


def test_scores_agree_with_a_plain_sampler(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", "e"], [8, 4, 2, 1, 1], k=rng.randint(1, 6))) for _ in range(40)]
    rows = [(i, x, None) for i, x in enumerate(texts) if not _held(i)]
    probes = ["a", "b", "c", "e", "zz"]
    held = [i for i in range(1000, 1200) if _held(i)][: len(probes)]
    kept = {}
    real = language_model.broadcast_model
    monkeypatch.setattr(language_model, "broadcast_model", lambda spark, m: kept.update(m) or real(spark, m))
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(rows + [(i, w, None) for i, w in zip(held, probes)], SCHEMA), rounds=12, samples=10).collect()}
    ask = [(b"", w.encode()) for w in probes] + [(w.encode(), b" ") for w in probes]
    want = plain_sampler([r[1] for r in rows], (kept["discount"], kept["discount0"]), language_model.THETA, language_model.ROOT, 220, ask, 5)
    for k, i in enumerate(held):
        # The unknown word depends on nothing but the parent's tables, which move with the whole corpus of six words.
        assert abs(got[i] - math.log10(want[k]) - math.log10(want[k + len(probes)])) < (0.08 if probes[k] != "zz" else 0.2), probes[k]


def test_numbers_of_tables_follow_their_distribution():
    discount = 0.6
    for opening in (0.02, 0.5, 3.0):
        # Two customers: two tables with odds opening : 1 - discount.
        t = language_model.seated(np.full(20_000, 2), discount, lambda rows, j: np.full(np.broadcast_shapes(rows.shape, np.shape(j)), opening), np.ones(20_000, int), np.random.default_rng(1))
        assert abs((t == 2).mean() - opening / (opening + 1 - discount)) < 0.02
    # Beyond EXACT customers the approximations must meet the full distribution.
    for opening in (0.05, 1.0, 20.0, 60.0, 300.0):
        c = np.full(4000, language_model.EXACT)
        means = [language_model.seated(c + k, discount, lambda rows, j: np.full(np.broadcast_shapes(rows.shape, np.shape(j)), opening), np.ones(4000, int), np.random.default_rng(2)).mean() for k in (0, 1)]
        assert abs(means[0] - means[1]) < 0.06 * means[0], (opening, means)


def test_edges(spark):
    assert language_model.score(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 3000, None), (3, "Word", None)]
    got = language_model.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 3001]
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
