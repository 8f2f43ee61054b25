import random

import pytest

from tipline.llm import ngram_join

SCHEMA = "doc_id long, text string, component string"


def brute(rows: list[tuple]) -> dict:
    """Index of row: (set size, component) by comparing every pair."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) and (k := len(a & b)) * 100 >= 80 * (len(a) + len(b) - k):
                parent[root(i)] = root(j)
    name = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            name[root(i)] = min(name.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), name.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def families(seed: int) -> list[tuple]:
    """Groups of edited copies around one text, chains of drifting copies, and a passage that many documents share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for f in range(6):
        base = rng.choices(words, k=rng.choice([12, 60, 150]))
        drift = list(base)
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            drift[rng.randrange(len(drift))] = rng.choice(words)
            rows += [" ".join(copy), " ".join(drift), passage + " " + " ".join(rng.choices(words, k=30))]
    rows += rows[:20] + [r.upper() for r in rows[:5]]
    return list(enumerate(rows, 10_000))


@pytest.mark.parametrize("outright", [0, 4, 1_000_000])
def test_families(spark, outright, monkeypatch):
    monkeypatch.setattr(ngram_join.set_links, "__defaults__", (5, 80, outright))
    monkeypatch.setattr(ngram_join, "FOLLOWERS", 7)
    rows = families(1)
    got = [tuple(r)[:3] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_unlinked_members_of_one_passage(spark):
    """Thousands of documents that share a passage, or two of a few passages, and are linked with few others."""
    rng = random.Random(9)
    passages = [" ".join(f"p{k}x{i}" for i in range(24)) for k in range(12)]
    alone = [f"{passages[0]} " + " ".join(f"d{d}y{i}" for i in range(rng.randint(12, 40))) for d in range(2500)]
    two = [" ".join([*rng.sample(passages, 2), f"e{d}"]) for d in range(300)]
    rows = list(enumerate(alone + two))
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[d] == d for d in range(2500))
    assert [got[d] for d in range(2500, 2800)] == [c + 2500 for _, _, c in sorted(brute(list(enumerate(two))))]


def test_against_brute_force(spark, sf_dir):
    extra = [(9001, None, ""), (9002, "", ""), (9003, " \n", ""), (9004, "A b", ""), (9005, "a  B", ""), (9006, "a b c d e", ""), (9007, "x " * 60_000, ""), (9008, "X " * 9, ""), (9009, "a b c d e", ""), (9009, "a b c d e", ""), (None, "a b c d e", ""), (None, "alone", "")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang as component").union(spark.createDataFrame(extra, SCHEMA))
    got = [tuple(r)[:3] for r in ngram_join.join(docs).collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_both_ways_to_components_agree(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "a long, b long")
    few, many = ({(r.id, r.component) for r in ngram_join.components(edges, small).collect()} for small in (1000, 0))
    assert few == many
