"""Merges that rewrite only what changes: same rows as a merge of whole tables, and files of other keys keep their names."""

import pytest
from pyspark.sql import functions as F

from tipline.operators.joins import append_best
from tipline.sources import manifest
from tipline.sources.manifest import Table
from tipline.streaming.merge import history_stream, merge_stream, movements, upsert_stream

SCHEMA = "k long, name string, v double, at long"
BY = ("at", ["name", "v"])


def rows(spark, keys, at, name="a"):
    return spark.createDataFrame([(k, f"{name}{k}", float(k or 0), at) for k in keys], SCHEMA)


def names(table) -> set:
    return set(table._names(table.manifest))


def content(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merges_equal_one_of_whole_tables(spark, tmp_path):
    table, whole = Table(spark, f"{tmp_path}/t", ["k"], buckets=4, bucket_rows=40), None
    assert table.read() is None and table.read(rows(spark, [], 0).schema).count() == 0
    for step, (keys, at) in enumerate([(range(0, 200), 1), (range(150, 260), 2), (range(0, 300, 7), 3), ([500, 500, None], 1), ([], 9), (range(140, 180), 0), ([None, 1], 5)]):
        new = rows(spark, keys, at, f"s{step}_")
        table.append(new, F.lit(0), *BY)
        whole = new if whole is None else append_best(whole, new, ["k"], F.lit(0), *BY)
        whole = spark.createDataFrame(append_best(whole.limit(0), whole, ["k"], F.lit(0), *BY).collect(), SCHEMA)
        assert content(table.read()) == content(whole)
    assert table.manifest.agg(F.max("buckets")).first()[0] > 4  # they doubled


def test_files_without_the_keys_stay(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", ["k"], buckets=16)
    table.append(rows(spark, range(0, 4000, 2), 1), F.lit(0), *BY)
    before = names(table)
    assert len(before) == 16
    done = table.append(rows(spark, [10, 12], 2, "new"), F.lit(0), *BY)
    after = names(table)
    assert done["rewritten"] <= 2 and done["kept"] == 16 - done["rewritten"] and len(before & after) == done["kept"]
    assert table.read().where("name LIKE 'new%'").count() == 2 and table.read().count() == 2000
    # New keys in between: the ranges hold them, the existence filters do not.
    done = table.append(rows(spark, range(1, 400, 2), 3, "odd"), F.lit(0), *BY)
    assert done["rewritten"] <= 2 and table.read().count() == 2200
    # New keys beyond all: nothing is rewritten.
    done = table.append(rows(spark, range(10_000, 10_050), 4), F.lit(0), *BY)
    assert done["rewritten"] == 0 and after <= before | names(table)


def test_readers_that_have_begun_go_on(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", ["k"], buckets=4)
    table.append(rows(spark, range(100), 1), F.lit(0), *BY)
    seen = table.read()
    table.append(rows(spark, range(50), 2, "b"), F.lit(0), *BY)
    assert content(seen) == content(rows(spark, range(100), 1))  # read after the merge
    assert table.read().where("at = 2").count() == 50


def test_small_files_are_written_together_and_old_ones_go(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", ["k"], buckets=1, bucket_files=3)
    for step in range(8):
        table.append(rows(spark, range(step * 10, step * 10 + 10), 1), F.lit(0), *BY)
        assert table.manifest.count() <= 3
    assert table.read().count() == 80
    folders = {p.name for p in (tmp_path / "t/data").iterdir()}
    assert len(folders) <= 2 * 3 + 1


def test_filters_lose_no_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "ROWS_PER_BITMAP", 100)  # several bitmaps a file
    table = Table(spark, f"{tmp_path}/t", ["k", "name"], buckets=3)
    table.append(rows(spark, range(3000), 1), F.lit(0), *BY)
    asked = rows(spark, range(3000), 2)
    assert table.touched(table.manifest, asked, 3, 3) == sorted(names(table))
    assert all(r.n > 0 and len(r.filter) > 1 for r in table.manifest.collect())
    table.append(asked, F.lit(0), *BY)
    assert table.read().count() == 3000 and table.read().where("at = 1").count() == 0


def test_small_buckets_end_where_files_get_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MANY_BUCKETS", 8, raising=False)
    table = Table(spark, f"{tmp_path}/t", ["k"], buckets=4, bucket_rows=10)
    for step in range(3):
        table.append(rows(spark, range(step * 100, step * 100 + 150), step), F.lit(0), *BY)
    assert len(names(table)) == 8 and table.read().count() == 350  # 40 rows a bucket, where 10 were asked for
    assert {tuple(r) for r in table.read().groupBy("at").count().collect()} == {(0, 100), (1, 100), (2, 150)}


def test_few_keys_first_finds_the_same_files(spark, tmp_path, monkeypatch):
    table = Table(spark, f"{tmp_path}/t", ["k"], buckets=8)
    table.append(rows(spark, range(0, 400, 2), 1), F.lit(0), *BY)
    found = []
    for first in (1, 3, 1 << 40):  # all keys, some, practically none in the first lookup
        monkeypatch.setattr(manifest, "FIRST_LOOKUP", first, raising=False)
        found.append([table.touched(table.manifest, rows(spark, keys, 2), 8, 8) for keys in ([4, 8, 5000], range(0, 400, 2), range(1, 60, 2))])
    assert found[0] == found[1] == found[2] and 1 <= len(found[0][0]) <= 3 and found[0][1] == sorted(names(table))


@pytest.fixture
def feed(spark, tmp_path):
    def more(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    return more


def test_streams_into_tables(spark, tmp_path, feed):
    schema = "k string, v double, at long, n long"
    batches = [[("a", 1.0, 1, 1), ("b", None, 1, 2), ("a", 2.0, 1, 3)], [("a", None, 2, 4), ("b", 7.0, 3, 5)], [("b", 5.0, 2, 6), (None, 4.0, 9, 7)]]
    for batch in batches:
        stream = feed(batch, schema)
        merge_stream(stream, f"{tmp_path}/m", f"{tmp_path}/cm", ["k"], F.lit(1), "at", ["n"]).awaitTermination()
        upsert_stream(stream, f"{tmp_path}/u", f"{tmp_path}/cu", ["k"], ["v"], "at", "n").awaitTermination()
        history_stream(stream, f"{tmp_path}/h", f"{tmp_path}/ch", ["k"], "v", "at").awaitTermination()
    assert content(Table(spark, f"{tmp_path}/m", ["k"]).read().select("k", "n")) == [("a", 4), ("b", 5), (None, 7)]
    assert content(Table(spark, f"{tmp_path}/u", ["k"]).read()) == [("a", 2.0), ("b", 5.0), (None, 4.0)]
    history = Table(spark, f"{tmp_path}/h", ["k"])
    moved = [("a", 1.0, 2.0, 1.0, 2), ("b", 5.0, 7.0, 2.0, 2), (None, 4.0, 4.0, 0.0, 1)]
    assert content(movements(history.read(), ["k"])) == moved
    assert history.read().count() == 3


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, feed, monkeypatch):
    schema = "k string, v double, at long"
    feed([("a", 1.0, 1), ("a", 2.0, 2)], schema)
    history_stream(feed([("b", 1.0, 1)], schema), f"{tmp_path}/h", f"{tmp_path}/c", ["k"], "v", "at").awaitTermination()
    stream = feed([("a", 3.0, 3), ("c", 1.0, 1)], schema)
    merge = Table.merge

    def fails_after(self, *args):
        merge(self, *args)
        raise RuntimeError("lost after the table was written")

    with monkeypatch.context() as m:
        m.setattr(Table, "merge", fails_after)
        with pytest.raises(Exception, match="lost after"):
            history_stream(stream, f"{tmp_path}/h", f"{tmp_path}/c", ["k"], "v", "at").awaitTermination()
    history_stream(stream, f"{tmp_path}/h", f"{tmp_path}/c", ["k"], "v", "at").awaitTermination()
    got = {r.k: r.n for r in Table(spark, f"{tmp_path}/h", ["k"]).read().collect()}
    assert got == {"a": 3, "b": 1, "c": 1}
