import random
import zlib

import pyarrow as pa

from tipline.llm import language_id

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang", "source as score")
    extra = [(90001, None, "en", ""), (90002, "", "en", ""), (90003, "12 34 !", None, ""), (90004, "漢字 かな", None, ""), (90005, "The and of " * 40_000, None, ""), (None, "the and of that", "en", ""), (90006, "x", None, ""), (90006, "x", None, "")]
    got = language_id.predict(docs.union(spark.createDataFrame(extra, SCHEMA))).collect()
    assert len(got) == docs.count() + len(extra)
    by = {r.doc_id: r for r in got}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(by[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (90001, 90002, 90003)] == ["und"] * 3 and by[90002].score == 0
    assert by[90005].lang_pred == "en" and by[90004].lang_pred in {"en", "de", "fr", "es"} and by[90004].score == 0


def test_filter_returns_every_language_of_a_gram(spark):
    rows = [(k, "gemeinsam nur" if lang == "a" else "gemeinsam allein", lang) for k, lang in enumerate("ab" * 20)]
    model = language_id.learn(spark.createDataFrame(rows, "draw long, text string, lang string"))
    shares = model.shares(*language_id.Grams().of(pa.array(["gemeinsam", "allein", "zzzzzzzz"])))
    a, b = model.languages.index("a"), model.languages.index("b")
    assert shares[0, a] > 0.9 and shares[0, b] > 0.9 and shares[1, b] > 0.9 and shares[1, a] < 0.5 and shares[2].max() < 0.1


def test_shares_against_exact_counts(spark):
    """The filter's corrected shares against sets of n-grams, for more languages than a mask word holds; every language has one or two documents."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(900)]
    texts = {f"l{k:03d}": " ".join(rng.choices(words[10 * k : 10 * k + 200], k=60)) for k in range(70)}
    model = language_id.learn(spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts.items())], "draw long, text string, lang string"))

    def grams(text: str) -> list[str]:
        text = f" {text} "
        return [text[i : i + 5] for i in range(len(text) - 4)]

    known = {lang: set(grams(t)) for lang, t in texts.items()}
    asked = [" ".join(rng.choices(words, k=40)) for _ in range(20)] + list(texts.values())[:5]
    shares = model.shares(*language_id.Grams().of(pa.array(asked)))
    for text, found in zip(asked, shares, strict=True):
        for lang, share in zip(model.languages, found, strict=True):
            assert abs(share - sum(g in known[lang] for g in grams(text)) / len(grams(text))) < 0.02


def test_a_language_of_one_document_is_learned(spark):
    rows = [(1, "der schnelle braune fuchs springt", "de", ""), (2, "the quick brown fox jumps", "en", ""), (3, "the quick brown fox jumps", None, ""), (4, "der schnelle fuchs", None, "")]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, SCHEMA), folds=10_007).collect()}
    assert got[3].lang_pred == "en" and got[3].score > 0.5 and got[4].lang_pred == "de"


def test_nothing_to_learn_from(spark):
    assert language_id.predict(spark.createDataFrame([], SCHEMA)).count() == 0
    got = language_id.predict(spark.createDataFrame([(1, "some text", None, "")], SCHEMA)).collect()
    assert got[0].lang_pred == "und" and got[0].score == 0
