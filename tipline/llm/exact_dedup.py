"""Exact deduplication over an extendible-hash index kept in shared files.

Every text is reduced to its form without white space; the leading bits of its SHA-256 are its key. Keys are counted first, so that only
texts whose key occurs again go on. Of these, the rows of one Arrow batch with equal bytes become one index entry: a text
that fills a third of the corpus is one entry a batch. The entries go into buckets addressed by the leading bits of the key. A directory says
how many bits each bucket uses: while a bucket holds more keys than its capacity, the directory doubles there and the bucket splits on
the next bit. The buckets lie in shared Parquet files sorted by key. Owner tasks each take a key range of these files, chain the
entries of a key that differ, comparing whole texts byte by byte, and elect the row of each class that stays. Nothing is equal because a
hash is: texts that share a key, or a digest, are links of one chain.

Defined results: null text is empty text; all empty texts form one group; of fully repeated rows exactly one is kept; a
null id loses ties and is returned as null; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import BITMAP_BITS, SPACE_BYTES, bitmap, slices, staged

#: Keys a bucket may hold before it splits.
BUCKET_KEYS = 65_536
#: Bytes of text worked on, or passed on, at a time (or one document).
SLICE_BYTES = 8 << 20


def _normal(batch: pa.RecordBatch, bits: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Texts without white space, their digests and keys."""
    norms = [(t or b"").translate(None, SPACE_BYTES) for t in batch.column(1).cast(pa.binary()).to_pylist()]
    digests = [hashlib.sha256(t).digest() for t in norms]
    keys = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64) >> np.uint64(64 - bits)
    return norms, digests, keys


def _keys(bits: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                values, n = np.unique(_normal(batch, bits)[2].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], names=["key", "n"])

    return keys


#: Rows of two kinds. n is null: a document, its entry (null: its key occurs once) and its rank among the entry's. Else: an entry with its best row and its
#: text, or the earlier entry of the same task that has the same text (same).
ENTRIES = "entry long, rank int, doc_id long, n_chars long, text_sha256 string, key long, norm binary, n long, same long"
#: Bytes of texts that a task remembers, so that a text that comes in every batch is sent to its owner once a task; texts beyond that are sent again.
KNOWN_BYTES = 32 << 20


def _entries(bits: int, wanted: np.ndarray):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        known: dict[bytes, int] = {}
        room = KNOWN_BYTES
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                norms, digests, keys = _normal(batch, bits)
                chars = pc.utf8_length(pc.fill_null(batch.column(1), "")).to_pylist()
                ids, again = batch.column(0).to_pylist(), wanted[keys << np.uint64(64 - bits) >> np.uint64(64 - BITMAP_BITS)].tolist()
                equal: dict[bytes, list[int]] = {}
                out = []
                for i, norm in enumerate(norms):
                    if again[i]:
                        equal.setdefault(norm, []).append(i)
                    else:
                        out.append((None, 0, ids[i], chars[i], digests[i].hex(), None, None, None, None))
                keys = keys.astype(np.int64).tolist()
                for norm, rows in equal.items():
                    rows.sort(key=lambda i: (-chars[i], ids[i] is None, ids[i] or 0))
                    out += [(entry, k, ids[i], chars[i], digests[i].hex(), None, None, None, None) for k, i in enumerate(rows)]
                    same = known.get(norm)
                    out.append((entry, 0, ids[rows[0]], chars[rows[0]], None, keys[rows[0]], norm if same is None else None, len(rows), same))
                    if same is None and len(norm) <= room:
                        known[norm] = entry
                        room -= len(norm)
                    entry += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return entries


def directory(entries: DataFrame, bits: int, bucket_keys: int) -> DataFrame:
    """Entries with the depth and number of their bucket. Overfull buckets split bit by bit until none is left, or no bit."""
    keys = staged(entries.select("key").distinct())
    full, buckets, depth, n = None, [], 0, keys.count()
    while depth < bits and n > bucket_keys << depth:  # a uniform hash needs at least so many bits
        depth += 1
    first = depth
    while True:
        keys = keys.withColumn("bucket", F.shiftrightunsigned("key", bits - depth) if depth else F.lit(0).cast("long"))
        full = staged(keys.groupBy("bucket").count().where(F.col("count") > bucket_keys).select("bucket"))
        if depth == bits or full.isEmpty():
            break
        buckets.append(full)
        keys, depth = keys.join(full, "bucket", "left_semi").drop("bucket"), depth + 1
    # An entry's bucket is the first of its prefixes that did not split.
    found = entries.withColumn("depth", F.lit(first))
    for d, split in enumerate(buckets, first):
        prefix = F.shiftrightunsigned("key", bits - d) if d else F.lit(0).cast("long")
        found = found.withColumn("bucket", prefix).join(split.withColumn("split", F.lit(True)), "bucket", "left")
        found = found.withColumn("depth", F.when((F.col("depth") == d) & F.col("split"), F.lit(d + 1)).otherwise(F.col("depth"))).drop("split", "bucket")
    # Buckets of one depth lie side by side in the order of keys; numbers of all depths are brought to full length.
    low = F.expr(f"shiftleft(shiftrightunsigned(key, {bits} - depth), {bits} - depth)")
    return found.withColumn("bucket", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(low))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, keep_entry, keep_id and group_size. Entries come sorted by key and entry; a key's chain has one link for each text that differs."""
    key, links, by_entry = None, [], {}

    def classes() -> pa.RecordBatch:
        rows = [(e, best[3], best[4], size) for _, best, size, members in links for e in members]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["entry", "keep_entry", "keep_id", "group_size"])

    for batch in batches:
        for k, entry, doc_id, n_chars, norm, n, same in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if k != key:
                if links:
                    yield classes()
                key, links, by_entry = k, [], {}
            best = (-n_chars, doc_id is None, doc_id or 0, entry, doc_id)
            link = by_entry[same] if norm is None else next((x for x in links if x[0] == norm), None)
            if link is None:
                links.append(link := [norm, best, 0, []])
            link[1], link[2] = min(link[1], best), link[2] + n
            link[3].append(entry)
            by_entry[entry] = link
    if links:
        yield classes()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 63, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. bits: of the key that addresses the index."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    again = source.mapInArrow(_keys(bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = bitmap(again.select(F.shiftleft("key", 64 - bits).alias("key")), "key")
    rows = staged(source.mapInArrow(_entries(bits, wanted), ENTRIES))
    entries = rows.where("n IS NOT NULL").select("key", "entry", "doc_id", "n_chars", "norm", "n", "same")
    index = staged(directory(entries, bits, bucket_keys).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"))
    owned = index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "entry")
    classes = owned.select("key", "entry", "doc_id", "n_chars", "norm", "n", "same").mapInArrow(_chained, "entry long, keep_entry long, keep_id long, group_size long")
    documents = rows.where("n IS NULL").select("entry", "rank", "doc_id", "text_sha256")
    kept = (F.col("entry") == F.col("keep_entry")) & (F.col("rank") == 0)
    joined = documents.where("entry IS NOT NULL").join(classes, "entry").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    # Documents whose key occurs once need no owner, and take no part in the join.
    alone = documents.where("entry IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return joined.unionByName(alone)
