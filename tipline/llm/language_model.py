"""Scoring texts with a hierarchical Pitman-Yor language model over words.

Each word is drawn in the restaurant of its context, the word before. All contexts share one parent restaurant of single words, with a discount and a
concentration of its own, which draws from all known words and one unknown word alike. Words with at least WORD_SHARE of all tokens are
contexts of their own; all others are contexts by a hash of CLASS_BITS bits, so that the number of contexts, which tasks must know of in
full, has a bound while the pairs of context and word grow with the corpus.

Seating is sampled by Gibbs in blocks: in a round all customers of a pair of context and word leave and are seated anew, by one draw from the
distribution of the number of their tables given all others; every table is a customer of the parent, where all customers of a word are seated
anew alike. Only the numbers of tables matter to predictions. Pairs of a word share a task, unless the word is frequent; half of a task's pairs
move at a time. Totals of other tasks are those of the round's start; they are summed anew after it. The predictive probabilities of
the last SAMPLES rounds are averaged.

Words are routed to tasks by hash in packed blocks, counted before they move. Frequent words are spread by context as well; their
number has a bound (2 / share), so their totals are broadcast, and so are the probabilities of the most frequent pairs, which
documents then look up without moving. Everything else meets its pair's task and comes back as one sum per document and task.

Defined results: null text is empty and has the end token only; rows that repeat an id are scored each; a null id counts as empty text in the
draw of the held-out part; without training documents every score is 0; an empty table gives an empty result. Two words share a 64-bit hash
with probability n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipline.llm.common import crc_bucket, dropped, staged, summed
from tipline.llm.words import Words, mixed

#: Words with at least this share of all tokens are contexts of their own and spread over tasks: 2 / share at most.
WORD_SHARE = 2.0**-16
#: Pairs with at least this share are looked up where the document is: 1 / share at most.
PAIR_SHARE = 2.0**-18
#: Training tokens whose pairs one task holds, tokens within which words are counted first.
BUCKET_TOKENS, CHUNK_TOKENS = 1_000_000, 1 << 20
#: Rounds of sampling, and how many of the last are averaged.
ROUNDS, SAMPLES = 4, 2
#: Concentration of a context, and of the parent.
THETA, ROOT = 1.0, 1.0
#: Customers up to which the distribution of the number of tables is computed in full; blocks that are unpacked at a time.
EXACT, LOT = 128, 64
#: Groups that pass the documents' own rows on.
PASSING = 64
END = np.uint64(0x2545F4914F6CDD1D)
#: log2 of the classes that words without a context of their own fall in, by hash.
CLASS_BITS = 20

_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(a: np.ndarray, dtype: str, rising: bool = False) -> bytes:
    a = np.ascontiguousarray(a, dtype)
    if rising:
        a = np.diff(a, prepend=a.dtype.type(0))
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpack(b: bytes, dtype: str, rising: bool = False) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = _ZSTD.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), asbytes=True) if b[:8] != bytes(8) else b""
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(a, dtype=a.dtype) if rising else a


def _found(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted value, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


class Tokens:
    """The tokens of slices of texts: route (the word, or the pair where the word is frequent), ctx, hid (the frequent word's number or 0), pair and doc."""

    def __init__(self, frequent: np.ndarray):
        self.words, self.frequent = Words(), frequent

    def slices(self, texts: pa.Array) -> Iterator[tuple]:
        for s in self.words.slices(texts):
            n_docs = s.last - s.first
            per_doc = np.diff(s.bounds)
            doc = np.repeat(np.arange(n_docs), per_doc + 1)
            at = np.arange(len(s.hashes)) + np.repeat(np.arange(n_docs), per_doc)
            w = np.full(len(s.hashes) + n_docs, END)
            w[at] = s.hashes
            k, hit = _found(self.frequent, w)
            hid = np.where(hit, k + 1, 0)
            own = hid[at]
            ctx = np.zeros(len(w), np.int64)
            ctx[at + 1] = np.where(own > 0, own, 1 + len(self.frequent) + (s.hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64))
            route = np.where(hid > 0, mixed(w, ctx), w)
            yield s.first, s.last, route, ctx, hid, mixed(route, ctx), doc


def contexts(frequent: np.ndarray) -> int:
    return 1 + len(frequent) + (1 << CLASS_BITS)


def _bucket(route: np.ndarray, buckets: int) -> np.ndarray:
    return ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _often(share: float):
    """Words of each chunk of tokens with a quarter of the share, and all tokens as word 0."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting, size = Words(), [], 0

        def chunk() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(waiting), return_counts=True)
            many = n >= share / 4 * size
            return pa.RecordBatch.from_arrays([pa.array(np.append(values[many], np.uint64(0)).view(np.int64)), pa.array(np.append(n[many], size).astype(np.int64))], names=["w", "n"])

        for batch in batches:
            for s in words.slices(batch.column(0)):
                waiting += [s.hashes, np.full(s.last - s.first, END)]
                size += len(s.hashes) + s.last - s.first
                if size >= CHUNK_TOKENS:
                    yield chunk()
                    waiting, size = [], 0
        if size:
            yield chunk()

    return often


COUNTED = "bucket int, route binary, ctx binary, hid binary, n binary"


def _counted(frequent, buckets: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(frequent.value)
        for batch in batches:
            for _, _, route, ctx, hid, pair, _ in tokens.slices(batch.column(0)):
                _, first, n = np.unique(pair, return_index=True, return_counts=True)
                order = np.argsort(route[first], kind="stable")
                first, n = first[order], n[order]
                route, ctx, hid = route[first], ctx[first], hid[first]
                b = _bucket(route, buckets)
                cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
                rows = [(int(b[i]), _pack(route[i:j], "u8", True), _pack(ctx[i:j], "u4"), _pack(hid[i:j], "u4"), _pack(n[i:j], "u4")) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "route", "ctx", "hid", "n"])

    return counted


#: word (light: its number in w, frequent: -hid), ctx and c: of all pairs, sorted by word. w, cw, n1: light words, their tokens and pairs with one customer.
#: ctxs, by_ctx: contexts met, with pairs, pairs of one customer and customers of each; hids, by_hid: frequent words alike; sums: seven sums.
SEATED = "bucket int, word binary, ctx binary, c binary, w binary, cw binary, n1 binary, ctxs binary, by_ctx binary, hids binary, by_hid binary, sums binary"


def _by(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and for each weight its sums by key."""
    keys, inverse = np.unique(key, return_inverse=True)
    return keys, np.concatenate([np.bincount(inverse, x, len(keys)).astype(np.int64) for x in weights])


def _row_of(schema: str, values: list) -> pa.Table:
    return pa.table([pa.array([x], pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(values)], names=[x.split()[0] for x in schema.split(", ")])


def _combined(parts: dict[str, list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """route, ctx, hid and count of the pairs of packed blocks, equal pairs added up; blocks are taken in small lots."""
    out = None
    for at in range(0, len(parts["route"]), LOT):
        route = np.concatenate([_unpack(b, "u8", True) for b in parts["route"][at : at + LOT]])
        ctx, hid, n = (np.concatenate([_unpack(b, "u4") for b in parts[c][at : at + LOT]]) for c in ("ctx", "hid", "n"))
        now = [route, ctx, hid, n.astype(np.int64)]
        if out is not None:
            now = [np.concatenate(x) for x in zip(out, now, strict=True)]
        pair = mixed(now[0], now[1])
        order = np.argsort(pair)
        cuts = np.flatnonzero(np.diff(pair[order], prepend=~pair[order[:1]]))
        first = order[cuts]
        out = [now[0][first], now[1][first], now[2][first], np.add.reduceat(now[3][order], cuts)]
    return out


def _grouped(key: tuple, table: pa.Table) -> pa.Table:
    """All pairs of a bucket."""
    route, ctx, hid, c = _combined({x: table.column(x).to_pylist() for x in ("route", "ctx", "hid", "n")})
    ctx, word = ctx.astype(np.int64), -hid.astype(np.int64)
    light = word == 0
    w, inverse = np.unique(route[light], return_inverse=True)
    word[light] = inverse
    order = np.argsort(word * (int(ctx.max(initial=0)) + 1) + ctx)
    word, ctx, c = word[order], ctx[order], c[order]
    light, one = word >= 0, c == 1
    cw, k, n1 = (np.bincount(word[light], x[light], len(w)).astype(np.int64) for x in (c, np.ones(len(c)), one))
    ctxs, by_ctx = _by(ctx, np.ones(len(c)), one, c)
    hids, by_hid = _by(-word[~light], np.ones(int((~light).sum())), one[~light], c[~light])
    sums = np.array([len(w), one.sum(), (c == 2).sum(), len(c), c.sum(), (k == 1).sum(), (k == 2).sum()])
    values = [key[0].as_py(), _pack(word, "i8", True), _pack(ctx, "u4"), _pack(c, "i8"), _pack(w, "u8", True), _pack(cw, "i8"), _pack(n1, "i8"), _pack(ctxs, "u4", True), _pack(by_ctx, "i8"), _pack(hids, "u4", True), _pack(by_hid, "i8"), _pack(sums, "i8")]
    return _row_of(SEATED, values)


def _total(df: DataFrame, keys: str, sums: str, width: int, length: int) -> np.ndarray:
    """width x length: the sums of all rows by key."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((width, length), np.int64)
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = _unpack(k, "u4", True)  # distinct
                out[:, at] += _unpack(v, "i8").reshape(width, -1)
        return out.ravel()

    return summed(df.select(keys, sums), build, np.add).reshape(width, length)


def _sums(df: DataFrame, width: int) -> np.ndarray:
    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(width, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                out += _unpack(v, "i8")
        return out

    return summed(df.select("sums"), build, np.add)


@lru_cache(maxsize=8)
def _partitions(discount: float) -> np.ndarray:
    """log S(c, t): weight of all ways to seat c customers at t tables, for c and t up to EXACT."""
    log = np.full((EXACT + 1, EXACT + 1), -np.inf)
    log[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        log[c + 1, 1 : c + 1] = log[c, 1 : c + 1] + np.log(c - discount * t)
        log[c + 1, 1 : c + 2] = np.logaddexp(log[c + 1, 1 : c + 2], log[c, : c + 1])
    return log


def seated(customers: np.ndarray, discount: float, opening, now: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of every restaurant's dish after all its customers left and were seated anew: one draw from the distribution of the number of tables.

    opening(rows, j): weight of opening table number j (0 first) for some rows; both may be arrays that fit each other. Up to EXACT customers the distribution is computed in full. For more,
    tables are a Poisson number of groups whose sizes add up to the customers: one giant table and a Poisson number of others while
    these are few, else normal about the saddle point; opening weights are then taken at half of the tables there are now."""
    tables = np.ones(len(customers), np.int64)
    small = np.flatnonzero((customers > 1) & (customers <= EXACT))
    order = small[np.argsort(customers[small], kind="stable")]
    values, starts = np.unique(customers[order], return_index=True)
    log_ways, ends = _partitions(discount), np.append(starts, len(order))[1:]
    for c, i, j in zip(values.tolist(), starts.tolist(), ends.tolist(), strict=True):
        for at in range(i, j, max(1, (1 << 20) // c)):
            rows = order[at : min(j, at + max(1, (1 << 20) // c))]
            weights = np.cumsum(np.log(opening(rows[:, None], np.arange(c)[None])), 1) + log_ways[c, 1 : c + 1]
            weights = np.cumsum(np.exp(weights - weights.max(1, keepdims=True)), 1)
            tables[rows] = 1 + (weights < (rng.random(len(rows)) * weights[:, -1])[:, None]).sum(1)
    rows = np.flatnonzero(customers > EXACT)
    if len(rows):
        c, f = customers[rows].astype(float), opening(rows, now[rows] // 2)
        low, high = np.full(len(rows), -200.0), np.zeros(len(rows))
        for _ in range(60):  # log y with f (1 - y) y^(discount - 1) = c
            mid = (low + high) / 2
            above = np.log(f) + np.log(-np.expm1(mid)) + (discount - 1) * mid > np.log(c)
            low, high = np.where(above, mid, low), np.where(above, high, mid)
        mean = -f * np.expm1(discount * low) / discount
        spread = mean - c * c / (c + f * (1 - discount) * np.exp((discount - 2) * low) * np.expm1(low) ** 2)
        few = 1 + rng.poisson(np.minimum(mean, 1e9))
        many = np.rint(rng.normal(mean, np.sqrt(np.maximum(spread, 1e-9))))
        tables[rows] = np.clip(np.where(mean < 30, few, many), 1, c).astype(np.int64)
    return tables


def _parent(m: dict, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Probability of words with k customers at t tables in the parent restaurant."""
    return (k - m["discount0"] * t + m["back"]) / (m["theta0"] + m["all"])


def parent_seated(m: dict, k: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of every word in the parent restaurant, all its k customers seated anew."""
    return seated(k, m["discount0"], lambda rows, j: (m["theta0"] + m["discount0"] * (np.maximum(m["all0"] - t[rows], 0) + j)) * m["base"], t, rng)


def children_seated(m: dict, c: np.ndarray, ctx: np.ndarray, t: np.ndarray, k: np.ndarray, t0: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of pairs with c customers. k, t0: customers and tables of each pair's word in the parent; the pair's own t are taken out first."""
    others = np.maximum(m["tables"][ctx] - t, 0)
    left = np.maximum(k - t, 0)
    kept = np.minimum(t0, left)

    def opening(rows: np.ndarray, j) -> np.ndarray:
        up = left[rows] + j - m["discount0"] * np.maximum(kept[rows], np.minimum(j, 1))
        return (m["theta"] + m["discount"] * (others[rows] + j)) * (np.maximum(up, 0) + m["back"]) / (m["theta0"] + np.maximum(m["all"] - t[rows], 0) + j)

    return seated(c, m["discount"], opening, t, rng)


STATE = "bucket int, n1 binary, word binary, ctx binary, c binary, now binary, now0 binary, tables binary, sampled binary, ctxs binary, by_ctx binary, hids binary, by_hid binary, sums binary"


def _round(number: int, model, sampling: bool):
    """One round over the pairs of each bucket. model: totals at its start. by_ctx, by_hid: tables of pairs with two or more customers afterwards; sums: those in all,
    and the light words' tables in the parent."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for row in batch.to_pylist():
                n1, word, ctx, c2 = _unpack(row["n1"], "i8"), _unpack(row["word"], "i8", True), _unpack(row["ctx"], "u4").astype(np.int64), _unpack(row["c"], "i8")
                if number == 0:  # pairs with one customer have one table for good
                    more = c2 > 1
                    word, ctx, c2 = word[more], ctx[more], c2[more]
                rng = np.random.default_rng([number, row["bucket"]])
                light = word >= 0
                t = _unpack(row["now"], "i8") if row.get("now") else np.ones(len(c2), np.int64)
                t0 = _unpack(row["now0"], "i8") if row.get("now0") else np.ones(len(n1), np.int64)
                half = rng.random(len(c2)) < 0.5
                for part in (half, ~half):  # the second half sees where the first half sits now
                    k = n1 + np.bincount(word[light], t[light], len(n1)).astype(np.int64)
                    t0 = np.minimum(t0, k)
                    own, own0 = m["frequent_k"][np.maximum(-word, 0)], m["frequent_t"][np.maximum(-word, 0)]
                    own[light], own0[light] = k[word[light]], t0[word[light]]
                    t[part] = children_seated(m, c2[part], ctx[part], t[part], own[part], own0[part], rng)
                k = n1 + np.bincount(word[light], t[light], len(n1)).astype(np.int64)
                t0 = parent_seated(m, k, np.minimum(t0, k), rng)
                tables = _unpack(row["tables"], "i8") if row.get("tables") else np.zeros(len(c2), np.int64)
                sampled = _unpack(row["sampled"], "i8") if row.get("sampled") else np.zeros(0, np.int64)
                if sampling:
                    tables, sampled = tables + t, np.concatenate([sampled, k, t0])
                ctxs, by_ctx = _by(ctx, t)
                hids, by_hid = _by(-word[~light], t[~light])
                sums = np.array([t.sum(), t0.sum()])
                out = [row["bucket"], row["n1"], _pack(word, "i8", True), _pack(ctx, "u4"), _pack(c2, "i8"), _pack(t, "i8"), _pack(t0, "i8"), _pack(tables, "i8"), _pack(sampled, "i8")]
                yield _row_of(STATE, [*out, _pack(ctxs, "u4", True), _pack(by_ctx, "i8"), _pack(hids, "u4", True), _pack(by_hid, "i8"), _pack(sums, "i8")]).to_batches()[0]

    return go


class Bucket:
    """Probabilities of one bucket's pairs and words, averaged over the samples."""

    def __init__(self, row: dict | None, m: dict):
        self.m = m
        samples = len(m["all"])
        row = row or dict.fromkeys(("word", "ctx", "c", "w", "cw", "tables", "sampled"), b"\0" * 8)
        self.word, self.ctx, self.c = _unpack(row["word"], "i8", True), _unpack(row["ctx"], "u4").astype(np.int64), _unpack(row["c"], "i8")
        self.w, self.cw = _unpack(row["w"], "u8", True), _unpack(row["cw"], "i8")
        light = self.word >= 0
        self.route = np.zeros(len(self.word), np.uint64)
        self.route[light] = self.w[self.word[light]]
        self.route[~light] = mixed(m["words"][-self.word[~light] - 1], self.ctx[~light])
        self.above = np.full(len(self.c), 1 - m["discount"])
        self.above[self.c > 1] = self.c[self.c > 1] - m["discount"] * _unpack(row["tables"], "i8") / samples
        k = _unpack(row["sampled"], "i8").reshape(samples, 2, -1)
        self.p = _parent(m, k[:, 0].T, k[:, 1].T)
        pair = mixed(self.route, self.ctx)
        self.order = np.argsort(pair)
        self.pair = pair[self.order]

    def _scored(self, above, word, known, ctx):
        """log10 probability and base of tokens. word: as in a bucket's pairs, any number where the word is not known."""
        m = self.m
        light = word >= 0
        p = np.tile(m["unknown"], (len(word), 1))
        c = np.zeros(len(word))
        here, far = light & known, ~light
        p[here], c[here] = self.p[word[here]], self.cw[word[here]]
        p[far], c[far] = m["frequent"].T[-word[far]], m["frequent_tokens"][-word[far]]
        down = ((m["theta"] + m["discount"] * m["tables"].T[ctx]) * p).mean(1)
        return np.log10((above + down) / (m["theta"] + m["customers"][ctx])), np.log10((c + 0.1) / (m["tokens"] + 0.1 * (m["vocabulary"] + 1)))

    def of_pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and base of the bucket's own pairs."""
        return self._scored(self.above[rows], self.word[rows], np.ones(len(rows), bool), self.ctx[rows])

    def of_tokens(self, route: np.ndarray, ctx: np.ndarray, hid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any tokens, and whether their word is known."""
        at, hit = _found(self.pair, mixed(route, ctx))
        above = np.where(hit, self.above[self.order[at]], 0.0) if len(self.pair) else np.zeros(len(route))
        k, there = _found(self.w, route)
        word = np.where(hid > 0, -hid, k)
        known = np.where(hid > 0, self.m["frequent_tokens"][hid] > 0, there)
        score, base = self._scored(above, word, known, ctx)
        return score, base, known


def _heavy(model, least: int):
    """pair, score, base of a bucket's most frequent pairs."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row, model.value)
                rows = np.flatnonzero(b.c >= least)
                score, base = b.of_pairs(rows)
                yield pa.RecordBatch.from_arrays([pa.array(mixed(b.route[rows], b.ctx[rows]).view(np.int64)), pa.array(score), pa.array(base)], names=["pair", "score", "base"])

    return heavy


#: Tokens of held-out documents as route, ctx, hid and doc; those of training documents, whose pairs the bucket knows, as pair and doc.
MOVED = "bucket int, docs long, pair binary, route binary, ctx binary, hid binary, doc binary, own binary"
#: Of a slice of documents: their own columns, or sums over the tokens that one bucket scored, by the document's place in the slice.
PARTS = "docs long, own binary, doc binary, known binary, base binary, score binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_OWN = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _moved(frequent, heavy, buckets: int):
    """Tokens of pairs that are not among the heavy ones, packed by bucket; what the heavy ones add is summed here and passed on with the document's own columns."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (pairs, scores, bases) = Tokens(frequent.value), heavy.value
        uid = TaskContext.get().partitionId() << 33
        types = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, route, ctx, hid, pair, doc in tokens.slices(batch.column(2)):
                at, hit = _found(pairs, pair)
                n = last - first
                near = doc[hit]
                own = [batch.column(0).slice(first, n), batch.column(1).slice(first, n), *(pa.array(np.bincount(near, x, n).astype(t)) for x, t in ((None, np.int64), (bases[at[hit]] if len(pairs) else None, float), (scores[at[hit]] if len(pairs) else None, float)))]
                own.insert(2, pa.array(np.bincount(doc, minlength=n)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _OWN) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays(own, schema=_OWN))
                rows = [(buckets + uid // 7 % PASSING, uid, None, None, None, None, None, sink.getvalue().to_pybytes())]
                apart = held[first:last][doc]
                for taught in (True, False):
                    rest = np.flatnonzero(~hit & (apart != taught))
                    by = pair if taught else route
                    rest = rest[np.argsort(by[rest], kind="stable")]
                    b = _bucket(route[rest], buckets)
                    order = np.argsort(b, kind="stable")
                    rest, b = rest[order], b[order]
                    cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        r = rest[i:j]
                        if taught:
                            rows.append((int(b[i]), uid, _pack(pair[r], "u8", True), None, None, None, _pack(doc[r], "u4"), None))
                        else:
                            rows.append((int(b[i]), uid, None, _pack(route[r], "u8", True), _pack(ctx[r], "u4"), _pack(hid[r], "u4"), _pack(doc[r], "u4"), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in MOVED.split(", ")])
                uid += n

    return moved


def _scored(model, buckets: int):
    names = [x.split()[0] for x in PARTS.split(", ")]

    def scored(key: tuple, tokens: pa.Table, state: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if tokens.num_rows and key[0].as_py() >= buckets:
            out = [(docs, own, None, None, None, None) for docs, own in zip(tokens.column("docs").to_pylist(), tokens.column("own").to_pylist(), strict=True)]
        elif tokens.num_rows:
            b = Bucket(state.to_pylist()[0] if state.num_rows else None, model.value)
            own_scores = [np.zeros(len(b.pair)), np.zeros(len(b.pair))]
            for at in range(0, len(b.pair), 1 << 17):
                for out_, x in zip(own_scores, b.of_pairs(b.order[at : at + (1 << 17)]), strict=True):
                    out_[at : at + len(x)] = x
            for row in tokens.to_batches(max_chunksize=LOT):
                for docs, pair, route, ctx, hid, doc in zip(*(row.column(c).to_pylist() for c in ("docs", "pair", "route", "ctx", "hid", "doc")), strict=True):
                    if pair is None:
                        score, base, known = b.of_tokens(_unpack(route, "u8", True), _unpack(ctx, "u4").astype(np.int64), _unpack(hid, "u4").astype(np.int64))
                    else:
                        at = np.searchsorted(b.pair, _unpack(pair, "u8", True))
                        score, base, known = own_scores[0][at], own_scores[1][at], np.ones(len(at))
                    values, inverse = np.unique(_unpack(doc, "u4"), return_inverse=True)
                    out.append((docs, None, _pack(values, "u4", True), _pack(np.bincount(inverse, known), "u4"), _pack(np.bincount(inverse, base), "f8"), _pack(np.bincount(inverse, score), "f8")))
        types = (pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=names)

    return scored


def _added(table: pa.Table) -> pa.Table:
    """The documents of one slice with the sums of all buckets."""
    own = pa.ipc.open_stream(next(x for x in table.column("own").to_pylist() if x is not None)).read_all()
    sums = [own.column(c).to_numpy().astype(t) for c, t in (("n_known", np.int64), ("base_score", float), ("score", float))]
    for doc, *parts in zip(*(table.column(c).to_pylist() for c in ("doc", "known", "base", "score")), strict=True):
        if doc is not None:
            at = _unpack(doc, "u4", True)
            for x, part, kind in zip(sums, parts, ("u4", "f8", "f8"), strict=True):
                x[at] += _unpack(part, kind)
    return pa.table([own.column(0), own.column(1), own.column(2), *map(pa.array, sums)], names=[x.split()[0] for x in SCORED.split(", ")])


def broadcast_model(spark: SparkSession, model: dict):
    """Sends what predictions need of all tasks; of bounded size."""
    return spark.sparkContext.broadcast(model)


def score(
    docs: DataFrame, folds: int = 10, rounds: int = ROUNDS, samples: int = SAMPLES, theta: float = THETA, root: float = ROOT,
    word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE, bucket_tokens: int = BUCKET_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_bucket(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = source.where("NOT held_out").select("text")

    often = staged(train.mapInArrow(_often(word_share), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    tokens = often.where("w = 0").agg(F.sum("n")).first()[0] or 0
    # Words with the whole share have more than half of it in the chunks where they were counted.
    frequent = often.where((F.col("w") != 0) & (F.col("n") >= word_share / 2 * tokens)).select("w").toArrow().column("w").to_numpy()
    frequent = broadcast(np.sort(frequent.view(np.uint64)))
    n_frequent, n_contexts = len(frequent.value), contexts(frequent.value)
    buckets = max(1, math.ceil(tokens / bucket_tokens))

    pairs = staged(train.mapInArrow(_counted(frequent, buckets), COUNTED).groupBy("bucket").applyInArrow(_grouped, SEATED))
    by_context, by_word = _total(pairs, "ctxs", "by_ctx", 3, n_contexts), _total(pairs, "hids", "by_hid", 3, n_frequent + 1)
    n_light, n1, n2, n_pairs, tokens, k1, k2 = (int(x) for x in _sums(pairs, 7))
    vocabulary = n_light + int((by_word[2][1:] > 0).sum())
    # Both discounts by the counts of ones and twos, as absolute discounting has them.
    fixed = {"discount": n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, "discount0": k1 / (k1 + 2 * k2) if k1 and k2 else 0.5, "theta": theta, "theta0": root, "base": 1 / (vocabulary + 1), "vocabulary": vocabulary}

    rng = np.random.default_rng(len(by_word[0]))
    words = by_word[0].copy()
    now = {"tables": by_context[0], "all": n_pairs, "frequent_k": words, "frequent_t": np.minimum(words, 1), "all0": vocabulary}
    state, kept = pairs.select("bucket", "n1", "word", "ctx", "c"), []
    for number in range(rounds):
        now |= fixed | {"back": (root + fixed["discount0"] * now["all0"]) * fixed["base"]}
        now["frequent_t"] = parent_seated(now, now["frequent_k"], now["frequent_t"], rng) * (now["frequent_k"] > 0)
        sampling = number >= rounds - samples
        before, state = state, staged(state.mapInArrow(_round(number, broadcast(now), sampling), STATE))
        dropped(before)
        tables, words = (_total(state, keys, sums, 1, n)[0] for keys, sums, n in (("ctxs", "by_ctx", n_contexts), ("hids", "by_hid", n_frequent + 1)))
        seats, light_tables = (int(x) for x in _sums(state, 2))
        words = by_word[1] + words
        now = {"tables": by_context[1] + tables, "all": n1 + seats, "frequent_k": words, "frequent_t": np.minimum(now["frequent_t"], words)}
        now["all0"] = light_tables + int(now["frequent_t"].sum())
        if sampling:
            kept.append(now)
    m = fixed | {"all": np.array([k["all"] for k in kept], float), "back": (root + fixed["discount0"] * np.array([k["all0"] for k in kept])) * fixed["base"], "tokens": tokens}
    m |= {"tables": np.array([k["tables"] for k in kept]), "frequent": _parent(m, *(np.array([k[x] for k in kept]).T for x in ("frequent_k", "frequent_t"))).T}
    model = broadcast_model(spark, m | {"customers": by_context[2], "frequent_tokens": by_word[2], "words": frequent.value, "unknown": _parent(m, np.zeros(1), np.zeros(1))})

    final = pairs.select("bucket", "word", "ctx", "c", "w", "cw").join(state.select("bucket", "tables", "sampled"), "bucket")
    least = max(2, math.ceil(pair_share * tokens))
    chosen = final.mapInArrow(_heavy(model, least), "pair long, score double, base double").toArrow()
    often = chosen.column("pair").to_numpy().view(np.uint64)
    order = np.argsort(often)
    heavy = broadcast((often[order], chosen.column("score").to_numpy()[order], chosen.column("base").to_numpy()[order]))
    moved = source.mapInArrow(_moved(frequent, heavy, buckets), MOVED)
    meet = _scored(model, buckets)
    parts = moved.groupBy("bucket").cogroup(final.groupBy("bucket")).applyInArrow(lambda key, tokens, state: meet(key, tokens, state), PARTS)
    return parts.groupBy("docs").applyInArrow(_added, SCORED).withColumn("train_tokens", F.lit(tokens).cast("long"))
