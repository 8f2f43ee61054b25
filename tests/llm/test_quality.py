import random

import numpy as np
import pytest

from tipline.llm import quality

DOCS = "doc_id long, text string, lang string, source string, label string"


def _docs(n):
    rng = random.Random(4)
    good, bad = [f"w{k}" for k in range(200)], [f"BUY{k}!!" for k in range(200)]
    rows = []
    for i in range(n):
        kind = i % 4 != 0
        rows.append((i, " ".join(rng.choices(good if kind else bad, k=rng.randint(20, 60))), "en", "s1" if kind else "s2", None))
    return rows


def test_separates_held_out_documents(spark):
    docs = spark.createDataFrame(_docs(400), DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 400
    held = [r for r in got if r.doc_id % 3]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert all(0 <= x <= 1 for r in got for x in (r.score, r.text_score, r.meta_score))


def test_thresholds_against_sorting():
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.beta(1, 8, 4000), rng.beta(9, 1, 6000)])
    histogram = np.bincount(np.minimum((p * quality.BINS).astype(int), quality.BINS - 1), minlength=quality.BINS)
    low, high = quality.thresholds(histogram, 300, 700, 0.5)
    ordered = np.sort(p)
    assert abs((p <= low).sum() - 300) < 30 and abs((p >= high).sum() - 700) < 60
    assert abs(low - ordered[300]) < 0.01 and abs(high - ordered[-700]) < 0.01
    low, high = quality.thresholds(histogram, 10_000, 10_000, 0.9)
    assert low == pytest.approx(0.1) and high == 0.9


def test_pseudo_labels_teach_what_no_label_shows(spark):
    """Words of a second kind of bad page occur in no labelled document; the metadata view, sure of its source, teaches them to the text view."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        kind = i % 3  # 0 good, 1 bad and labelled, 2 bad and unlabelled
        words = [[f"w{k:03d}" for k in range(150)], [f"BUY{k:03d}!!" for k in range(150)], [f"zzz{k:03d}zz" for k in range(150)]][kind]  # both bad kinds are of one size
        rows.append((i, " ".join(rng.choices(words, k=40)), "en", "s1" if kind == 0 else "s2", None))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 900) if i % 3 < 2 and i % 5 == 0], "doc_id long, quality int")
    before = {r.doc_id: r.text_score for r in quality.classify(docs, labels, rounds=0).collect()}
    after = {r.doc_id: r.text_score for r in quality.classify(docs, labels, rounds=3).collect()}
    second = [i for i in before if i % 3 == 2]
    assert sum(after[i] for i in second) < sum(before[i] for i in second)
    assert sum((after[i] >= 0.5) == (i % 3 == 0) for i in after) > 0.95 * len(after)


def test_repeated_rows_of_a_labelled_document(spark):
    docs = spark.createDataFrame(_docs(60) + [(0, "w1 w2 w3 " * 10, "en", "s1", None)] * 500, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(60)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 560


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(None, None, None, None, "x"), (1, "", "en", None, "x"), (1, "", "en", None, "x"), (2, "long " * 5000, None, "s", None)]
    got = quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert [r.score for r in got] == [0.5] * 4
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = {(r.doc_id, r.score) for r in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == 3
