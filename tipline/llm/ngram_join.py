"""Exact n-gram Jaccard self-join of documents, with set relations used to skip index entries and comparisons.

A document is the set of its word shingles (64-bit hashes). Equal sets share one answer and enter once. All sets sort their
shingles by one global order, rarest first as far as a sketch of fixed size can tell, and index the shortest prefix that any
similar set must hit. An entry's position bounds the size of the sets it can still be similar to, so lists are blocked by the size of the
smaller set: an entry goes to the blocks that its size and position allow and to no others, so whole blocks are skipped, and within a
block pairs out of each other's reach.

Short lists are compared outright. In longer ones the answers of a leader are computed first: the entry with the least position for its size, which
differs least from what the list has in common. Answers of the others are derived from it: those linked with it are in its component and are not
compared with each other; for all others, the tokens shared with the leader and those beyond it bound what any two can share. Lists are worked off
with more leaders in each round, taken from different components, until every pair that could add a link has been compared. A comparison is made
where the leader's set lies; sets of a leader with many followers lie in several places. Components come from a large-star/small-star
contraction, or from one task while the links are few. No step lists the pairs of a group of similar sets.

Defined results: null text is empty; a document without words has the empty set and is linked with nothing; fewer words than a
shingle has form one shingle; rows that repeat an id are one document per row; a null id takes part and its component is
named by the smallest other id, or null. Two of n distinct shingles get the same hash with probability n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import BITMAP_BITS, SPACE_BYTES, bitmap, sized, staged, summed

#: Words in a shingle, and the similarity in per cent from which documents are linked.
WORDS, PERCENT = 5, 80
#: log2 of the counters of the frequency sketch (4 MB, whatever the input), sets a task remembers, and bytes of text hashed at a time.
SKETCH_BITS, REMEMBERED, SLICE_BYTES = 20, 1_000_000, 1 << 20
#: Rows of one or two numbers up to which the pairs of a round are broadcast.
SMALL = 400_000
#: Size blocks in a factor of 100 / percent; pairs per entry up to which a list is compared outright.
STEPS, OUTRIGHT = 4, 8
#: Leaders of a list grow by this factor from round to round; pairs of one leader that are compared in one place.
LEADERS, FOLLOWERS = 8, 1024
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


class Shingler:
    """Sorted distinct shingle hashes of the texts of an Arrow array, a slice of texts at a time in numpy.

    A word's hash is a polynomial over random 64-bit values of its bytes (A-Z as a-z), read off running sums."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, words: int = WORDS):
        self.words = words
        self.value = np.random.default_rng(20).integers(1 << 63, (1 << 64) - 1, 256, np.uint64, endpoint=True)
        self.value[65:91] = self.value[97:123]
        self.space = np.isin(np.arange(256), np.frombuffer(SPACE_BYTES, np.uint8))
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, SLICE_BYTES)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES)) - 1)
            yield from self._slice(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        n, w = len(data), self.words
        self._powers(n)
        space = self.space[data]
        opens, closes = np.ones(n, bool), np.ones(n, bool)
        opens[1:], closes[:-1] = space[:-1], space[1:]
        opens[offsets[offsets < n]] = True
        closes[offsets[offsets > 0] - 1] = True
        starts, ends = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(31)
        many = max(0, len(h) - w + 1)
        out = self._mixed([h[k : k + many] for k in range(w)])
        firsts = np.searchsorted(starts, offsets).tolist()
        for a, b in zip(firsts, firsts[1:], strict=False):
            if b - a >= w:
                s = np.sort(out[a : b - w + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield self._mixed([h[k : k + 1] for k in range(a, b)]) if b > a else h[:0]

    @staticmethod
    def _mixed(parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), len(parts), np.uint64)
        for k, p in enumerate(parts):
            out = (out ^ p) * _MIX[k % 4]
            out ^= out >> np.uint64(29)
        out *= _MIX[4]
        out ^= out >> np.uint64(32)
        out *= _MIX[5]
        return out ^ out >> np.uint64(29)


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _row_keys(batch: pa.RecordBatch) -> list[int]:
    """A hash of each row's doc_id and raw text."""
    pairs = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
    return [int.from_bytes(hashlib.blake2b(t or b"", digest_size=8, salt=str(i).encode()[:16]).digest(), "little", signed=True) for i, t in pairs]


def _sketch(words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        shingler, counts = Shingler(words), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for s in shingler.sets(batch.column(0)):
                counts[s >> np.uint64(64 - SKETCH_BITS)] += np.uint32(1)  # two of one set in one counter count once: only the order of tokens depends on it
        return counts

    return build


def _rows(words: int):
    """doc_id, n_shingles, sid (hash of the set) and row (hash of the row) of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            ns, sids = [], []
            for s in shingler.sets(batch.column(1)):
                ns.append(len(s))
                sids.append(_set_id(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), pa.array(_row_keys(batch), pa.int64())], names=["doc_id", "n_shingles", "sid", "row"])

    return rows


def _prefixes(words: int, percent: int, counts: np.ndarray):
    """token, sid, n, pos: the index prefix of each set, once per set and task."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            tokens, sids, ns, lengths = [], [], [], []
            for s in shingler.sets(batch.column(0)):
                n = len(s)
                if not n or (sid := _set_id(s)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(sid)
                p = n - -(-percent * n // 100) + 1
                rank = counts[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(32) | s >> np.uint64(32)
                tokens.append(s[np.argsort(rank, kind="stable")[:p]])
                sids.append(sid)
                ns.append(n)
                lengths.append(p)
            if tokens:
                reps = np.array(lengths)
                pos = np.concatenate([np.arange(p, dtype=np.int32) for p in lengths])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), reps)), pa.array(np.repeat(np.array(ns, np.int32), reps)), pa.array(pos)], names=["token", "sid", "n", "pos"])

    return prefixes


def _wanted_sets(words: int, bits: np.ndarray):
    """sid and sorted hashes of the rows whose bit is set."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            keys = np.array(_row_keys(whole), np.int64).view(np.uint64)
            chosen = whole.filter(pa.array(bits[keys >> np.uint64(64 - BITMAP_BITS)]))
            for at in range(0, chosen.num_rows, 500):
                sets = list(shingler.sets(chosen.column(1).slice(at, 500)))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["sid", "hashes"])

    return wanted


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of a bounded number of edges, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """id, component (the smallest id reachable) of each end of the edges (columns a, b; long). Up to small edges go to one task; more are contracted over all."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.limit(small + 1).count() <= small:
        return edges.coalesce(1).mapInArrow(_united, "id long, component long")

    def star(both: DataFrame, least: DataFrame, condition: str) -> DataFrame:
        return both.join(least, "u").where(condition).select(F.col("v").alias("a"), F.col("m").alias("b"))

    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = star(both, least, "v > u").where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = star(down, low, "v > m").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:  # a forest of stars
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now


def _reaches(percent: int, x: str, y: str) -> str:
    """Size and position of two entries allow the similarity. Written for the pair's first common token."""
    bound = f"least(n{x} - pos{x}, n{y} - pos{y})"
    return f"100 * least(n{x}, n{y}) >= {percent} * greatest(n{x}, n{y}) AND {100 + percent} * cast({bound} AS long) >= {percent} * (cast(n{x} AS long) + n{y})"


def _derived(percent: int, x: str, y: str) -> str:
    """What two sets share of one leader's answers still allows the similarity. o: tokens shared with that leader, or null."""
    bound = f"least(o{x}, o{y}) + least(n{x} - o{x}, n{y} - o{y})"
    return f"coalesce({100 + percent} * ({bound}) >= {percent} * (cast(n{x} AS long) + n{y}), true)"


def _blocks(percent: int):
    """Blocks that an entry goes to, by the size of the pair's smaller set: from the least size it can meet to its own, as its position allows."""
    def block(n):
        return F.floor(F.log(n.cast("double")) * F.lit(STEPS / math.log(100 / percent)) + F.lit(1e-9)).cast("int")

    n, pos = F.col("n").cast("long"), F.col("pos")
    most = F.floor(((100 + percent) * (n - pos) - percent * n) / percent)  # the largest set that can share enough
    return F.sequence(block(F.greatest(F.lit(1), F.ceil(n * percent / 100))), block(F.least(n, F.greatest(F.lit(1), most))))


def _verified(pairs: DataFrame, rows: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, linked and o (shared tokens) of pairs. Reads the texts again, but shingles only those that a pair needs. b's set is copied for every
    FOLLOWERS pairs it is in, so that a leader of many does not meet them all in one place."""
    pairs = staged(pairs.distinct())
    needed = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    chosen = rows.join(sized(needed, SMALL), "sid").groupBy("sid").agg(F.min("row").alias("row"))
    sets = staged(source.mapInArrow(_wanted_sets(words, bitmap(chosen, "row")), "sid long, hashes array<bigint>"))
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("copies"))
    dealt = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"))
    left = sets.join(sized(dealt, SMALL), sets.sid == F.col("a")).select("a", "b", "copy", F.col("hashes").alias("ha"))
    right = sets.join(sized(copies, SMALL), sets.sid == F.col("b")).select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("hashes").alias("hb"))
    both = left.join(right, ["b", "copy"]).select("a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("o"), (F.size("ha") + F.size("hb")).cast("long").alias("s"))
    return staged(both.select("a", "b", (F.col("o") * 100 >= (F.col("s") - F.col("o")) * percent).alias("linked"), "o").distinct())


def set_links(rows: DataFrame, source: DataFrame, words: int = WORDS, percent: int = PERCENT, outright: int = OUTRIGHT) -> DataFrame:
    """id, component of the sets (by sid) that are linked with another one. source: doc_id, text; rows: made of it by _rows()."""
    texts = source.select("text")
    counts = summed(texts, _sketch(words), np.add)
    entries = texts.mapInArrow(_prefixes(words, percent, counts), "token long, sid long, n int, pos int")
    shared = entries.withColumn("low", F.expr("min(sid) OVER (PARTITION BY token)")).withColumn("high", F.expr("max(sid) OVER (PARTITION BY token)")).where("low < high")
    blocked = shared.select("token", "sid", "n", "pos", F.explode(_blocks(percent)).alias("block"))
    lists = staged(blocked.groupBy(F.xxhash64("token", "block").alias("lid"), "sid").agg(F.min("n").alias("n"), F.min("pos").alias("pos")))
    ends = lists.groupBy("lid").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("lid")
    lists = staged(lists.join(ends, "lid").withColumn("component", F.col("sid")).withColumn("o", F.lit(None).cast("long")))
    none = texts.sparkSession.createDataFrame([], "id long, component long")
    links = none.select(F.col("id").alias("a"), F.col("component").alias("b"))
    turn = 0
    while True:
        spread = lists.groupBy("lid", "component").agg(F.count("*").alias("k")).groupBy("lid").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("kinds"))
        pairs_left = (F.col("m") * F.col("m") - F.col("same")) / 2
        leaders = LEADERS**turn
        whole = (pairs_left <= outright * F.col("m")) | (F.col("kinds") <= leaders)
        spread = staged(spread.where("kinds > 1").select("lid", whole.alias("whole")))
        if spread.isEmpty():
            break
        lists = lists.join(spread, "lid")
        short, long = lists.where("whole"), staged(lists.where("NOT whole").drop("whole"))
        x, y = (short.select("lid", *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "n", "pos", "component", "o")]) for s in "xy")
        met = x.join(y, "lid").where(f"sid_x < sid_y AND component_x <> component_y AND {_reaches(percent, '_x', '_y')} AND {_derived(percent, '_x', '_y')}")
        pairs = met.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b"))
        # One leader of each of so many groups of components: the first in position for its size.
        place = F.struct((F.col("pos") / F.col("n")).alias("at"), "sid", "n", "pos", "component", "o")
        heads = long.groupBy("lid", F.pmod(F.xxhash64("component", F.lit(turn)), F.lit(leaders)).alias("group")).agg(F.min(place).alias("head"))
        heads = staged(heads.select("lid", "group", *[F.col(f"head.{c}").alias(f"{c}_y") for c in ("sid", "n", "pos", "component", "o")]))
        here = long.withColumnsRenamed({c: f"{c}_x" for c in ("sid", "n", "pos", "component", "o")}).join(sized(heads), "lid")
        here = here.where(f"sid_x <> sid_y AND component_x <> component_y AND {_reaches(percent, '_x', '_y')} AND {_derived(percent, '_x', '_y')}")
        pairs = pairs.unionByName(here.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")))
        done = _verified(pairs, rows, source, words, percent)
        links = staged(links.unionByName(done.where("linked").select("a", "b")))
        known = components(links)
        lists = long.join(sized(heads.select("lid", F.col("sid_y").alias("sid"))), ["lid", "sid"], "left_anti")
        if turn == 0:  # what a list's entries share with its one leader
            lists = lists.drop("o").join(sized(heads.select("lid", "sid_y")), "lid").join(done.select(F.col("a").alias("sid"), F.col("b").alias("sid_y"), "o"), ["sid", "sid_y"], "left").drop("sid_y")
        named = lists.drop("component").join(known.withColumnRenamed("id", "sid"), "sid", "left")
        lists = staged(named.withColumn("component", F.coalesce("component", "sid")))
        turn += 1
    return components(links)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), sid (equal for equal sets)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(source.mapInArrow(_rows(words), "doc_id long, n_shingles long, sid long, row long"))
    linked = set_links(rows, source, words, percent)
    named = rows.join(linked.withColumnRenamed("id", "sid"), "sid", "left")
    # The empty set is linked with nothing, not even with itself.
    named = staged(named.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "sid"))))
    names = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(names, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "sid")
