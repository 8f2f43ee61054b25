import pathlib
import re
import zlib
from collections import Counter

import corpus_pipeline
from tipline.llm.common import documents, staged


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_on_small_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        out[name] = docs.collect()
        if name != "pack":
            assert docs.columns == names
    assert 0 < len(out["language"]) <= documents(spark, sf_dir).count()
    # No line of five words or more is left twice.
    seen = Counter(" ".join(x.lower().split()) for r in out["lines"] for x in r.text.split("\n") if len(x.split()) >= 5)
    assert max(seen.values()) == 1
    # No two documents that stay are similar, and every one that went is linked with another one.
    before, after = ([(r.doc_id, _sets(r.text)) for r in out[k]] for k in ("lines", "near_duplicates"))
    stay = {i for i, _ in after}
    linked = {i for i, a in before for j, b in before if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)}
    assert not {i for i, a in after for j, b in after if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b)}
    assert {i for i, _ in before} - stay <= linked
    copies = Counter(r.doc_id for r in out["mix"])
    assert set(copies) <= stay and max(copies.values()) <= 2
    # Every document that the mix took is packed whole and without overlap.
    assert Counter(r.doc_id for r in out["pack"] if r.piece == 0) == copies
    places = {}
    for r in out["pack"]:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "123 456", None, "s", 7), (3, "the same words again and again\n" * 3, "en", None, 93), (4, "la même chose encore une fois", "fr", "s", 29)]
    for data in ([], rows):
        docs, ids = spark.createDataFrame(data, schema), {}
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, ""))
            ids[name] = Counter(r.doc_id for r in docs.collect())
        # Null, empty and letterless texts are in no language; a source's only document is taken once or twice.
        assert set(ids["language"]) == set(ids["lines"]) == set(ids["near_duplicates"]) == ({3, 4} if data else set())
        assert set(ids["mix"]) <= {3, 4} and ids["pack"] == ids["mix"] and bool(ids["pack"]) == bool(data)


def test_nulls_and_clashing_columns_in_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, copies int, component_id long, place string"
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text, None, None, None, 1, None, 9, None, "x"), (5, text, "en", "s", 48, 2, "d", None, 4, None), (6, None, None, "s", None, None, None, None, None, None), (7, "", "en", "s", 0, 1, "", 1, 1, "")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((r.doc_id, r.row) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [(5, 2), (6, None), (7, 1)]
    assert {r.doc_id for r in corpus_pipeline.lines(spark, docs, "").collect()} >= {5, 6, 7}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert all(r.copies in (9, None) and r.row in (1, 2) for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert sorted((r.doc_id, r.length) for r in corpus_pipeline.pack(spark, docs, "").collect() if r.doc_id in (6, 7)) == [(6, 1), (7, 1)]


def test_short_lines_and_lines_without_spaces_collapse(spark):
    chinese, thai = "今天的天气非常好我们去公园散步", "สวัสดีครับวันนี้อากาศดีมาก"
    rows = [
        (1, f"Home\nread more\n{chinese}\n\nonly here", "en", "s", 0),
        (2, f"HOME\nRead  more\n{chinese}\n\nkept", "en", "s", 0),
        (3, f"home\n{chinese.replace('好', '坏')}\n{thai}\n好的", "zh", "s", 0),
        (4, f"{thai.replace('ดี', 'ดีๆ', 1)}\n坏的\nfour words stay here", "th", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "\nkept", 3: f"{thai}\n好的", 4: "坏的\nfour words stay here"}


def test_language_keeps_short_texts_and_languages_with_few_documents(spark):
    english = "the quick brown fox jumps over the lazy dog and then runs back to the old river bank"
    spanish = [
        "ayer compramos naranjas dulces junto al puerto viejo mientras llovía sobre tejados rojos",
        "mañana visitaremos pueblos blancos donde abuelas tejen mantas y cuentan historias de marineros junto al puerto",
    ]
    ids = iter([i for i in range(200) if zlib.crc32(str(i).encode()) % 5])  # those that are learned from
    rows = [(next(ids), english, "en", "s", 0) for _ in range(20)] + [(next(ids), x, "es", "s", 0) for x in spanish]
    short, foreign, digits = 1001, 1002, 1003
    rows += [(short, "OK", None, "s", 2), (foreign, "xqzvk wjqxz kkvzq zzxqj vvkqx", None, "s", 29), (digits, "12 34", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {r[0] for r in rows} - {foreign, digits}


def test_what_a_stage_staged_goes_when_the_next_one_begins(spark, sf_dir, tmp_path):
    exists = lambda t: pathlib.Path("/" + t._staged_at.split(":", 1)[-1].lstrip("/")).exists()
    docs = documents(spark, sf_dir).limit(80)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.lines(spark, docs, sf_dir)
    staged_then = list(corpus_pipeline._before)
    assert staged_then and all(map(exists, staged_then))
    # Not written yet: the next stage reads what this one staged, which stays.
    lazily = corpus_pipeline.near_duplicates(spark, out, sf_dir).count()
    read = [t for t in staged_then if exists(t)]
    assert read
    out.write.parquet(f"{tmp_path}/lines")
    written = spark.read.parquet(f"{tmp_path}/lines")
    assert corpus_pipeline.near_duplicates(spark, written, sf_dir).count() == lazily
    assert not any(map(exists, staged_then))
