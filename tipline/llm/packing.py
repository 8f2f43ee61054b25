"""Best-fit packing of tokenised documents into fixed-length sequences, improved by a swap-based local search.

Documents are tokenised inside Spark tasks and cut into pieces of at most the sequence length. Pieces are dealt to groups of
bounded size by their place in the staged files; each group is packed in one task. Best fit (longest first) gives a start; the
local search then moves a piece, or exchanges one for one or two for one, between underfull bins as long as any such step
raises the sum of squared fills, so that full bins get fuller and the emptiest run out. Part-filled bins of all groups are
packed again, together, until one group is left. Groups are independent: a lost executor costs a retry.

Defined results: a null text is empty and gives one piece with the end id only; rows that repeat an id give pieces of their
own; empty tables give empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import staged, trimmed
from tipline.llm.words import Slice, Words

#: Tokens of a sequence, and pieces that one task packs at a time.
LENGTH, GROUP_PIECES = 2048, 12_000
#: Words whose ids a worker keeps, and bytes of text tokenised at a time (or one document).
REMEMBERED, SLICE_BYTES = 600_000, 2 << 20
#: Bins of several groups filled up to this share of the length are packed once more, together.
REOPEN = 15 / 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids:
    """Token ids by word hash. White space separates tokens in this vocabulary and A-Z counts as a-z, so words are independent and found by the
    hash that ignores the case of A-Z. Two of n distinct words share a hash with probability n^2 / 2^65."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.words = Words(SLICE_BYTES)
        self.cores: dict[bytes, bytes] = {}
        self.hashes, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes. Letters and the stops after them are separate tokens, so each sequence of letters is encoded once."""
        cores, parts = self.cores, []
        for w in words:
            w = w.lower()
            core = w.rstrip(b".,")
            parts.append((core, w[len(core) :]) if len(core) < len(w) and _splits(core) else (w,))
        new = list({c for p in parts for c in p if c not in cores})
        for at in range(0, len(new), 1000):
            some = [c.decode() for c in new[at : at + 1000]]
            coded = self.encode(" ".join(some), add_special_tokens=False)
            raw = np.array(coded.ids, dtype="<u4").tobytes()
            starts = np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded))
            ends = (4 * np.searchsorted(starts, np.cumsum([len(c) + 1 for c in some]))).tolist()
            begin = 0
            for c, end in zip(new[at : at + 1000], ends, strict=True):
                cores[c] = raw[begin:end]
                begin = end
        out = [cores[p[0]] if len(p) == 1 else cores[p[0]] + cores[p[1]] for p in parts]
        if len(cores) > REMEMBERED:
            cores.clear()
        return out

    def _learn(self, s: Slice, hashes: np.ndarray, first: np.ndarray) -> None:
        """Adds words not seen before; once more than REMEMBERED are known, only the slice's own are."""
        raw = s.data.tobytes()
        coded = self._encoded([raw[i:j] for i, j in zip(s.starts[first].tolist(), s.ends[first].tolist(), strict=True)])
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), "<u4")])
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.size = (np.insert(old, where, new) for old, new in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))

    def of(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of a slice, one after the other, and their number for each word."""
        hashes, first = np.unique(s.hashes, return_index=True)
        at = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        if len(self.hashes) + (~known).sum() > REMEMBERED:
            self.hashes, self.begin, self.size, self.ids = self.hashes[:0], self.begin[:0], self.size[:0], self.ids[:0]
            known[:] = False
        if not known.all():
            self._learn(s, hashes[~known], first[~known])
        at = np.searchsorted(self.hashes, s.hashes)
        size = self.size[at]
        upto = np.cumsum(size) - size
        return self.ids[np.repeat(self.begin[at] - upto, size) + np.arange(int(size.sum()))], size


def _splits(core: bytes) -> bool:
    """Whether stops behind these letters are tokens of their own: the last letter, once normalised, must be no mark that would join them."""
    if core.isalpha():
        return True
    text = core.decode()
    return text.isalpha() and unicodedata.normalize("NFC", text).lower()[-1].isalpha()


#: Kept for the next task of the same Python worker; it only saves time.
_KNOWN: dict[str, _Ids] = {}


def _cutter(path: str, length: int, end_id: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _KNOWN.get(path) or _KNOWN.setdefault(path, _Ids(path))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for s in ids_of.words.slices(batch.column(1)):
                ids, size = ids_of.of(s)
                upto = np.concatenate([[0], np.cumsum(size)])[s.bounds].tolist()
                raw, out = ids.tobytes(), []
                for doc_id, i, j in zip(batch.column(0).slice(s.first, s.last - s.first).to_pylist(), upto, upto[1:], strict=False):
                    n = j - i + 1
                    for k, start in enumerate(range(0, n, length)):
                        part = raw[4 * (i + start) : 4 * min(j, i + start + length)]
                        last = start + length >= n
                        out.append((doc_id, k, start, len(part) // 4 + last, zlib.crc32(part + end if last else part)))
                yield _piece_batch(out)

    return cut_up


def _piece_batch(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(trimmed(_cutter(tokenizer_path, length, end_id)), PIECES)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of indices; longest first, each into the fullest bin it fits."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms: list[int] = []  # distinct rooms in use, sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, room = len(bins), length
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[b].append(i)
        if room := room - sizes[i]:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins


class _Open:
    """The underfull bins of a search, indexed by what an exchange needs to know: the size of a piece or pair, and the fill of its bin. Bins that are alike in
    this are one line of the index, so that its length does not depend on how many pieces there are of a size."""

    def __init__(self, bins: list[list[int]], sizes: list[int], length: int):
        self.bins, self.sizes, self.length = bins, sizes, length
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.lines: dict[tuple[int, bool, int], int] = {}  # (size, a pair?, fill) to its place in the arrays
        self.size, self.pair, self.full, self.count = (np.zeros(64, t) for t in (np.int64, bool, np.int64, np.int64))
        self.members: list[dict[int, None]] = []  # bins of each line, in the order they came
        self.parts = [self._parts(b) for b in range(len(bins))]
        for b in range(len(bins)):
            self._enter(b)

    def _parts(self, b: int) -> dict[tuple[int, bool], tuple[int, ...]]:
        """For each size of nothing, a piece, or a pair of a bin: one choice of pieces."""
        by_size: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by_size.setdefault(self.sizes[i], []).append(i)
        found: dict[tuple[int, bool], tuple[int, ...]] = {(0, False): ()} | {(s, False): (own[0],) for s, own in by_size.items()}
        kinds = sorted(by_size)
        for k, s in enumerate(kinds):
            if len(by_size[s]) > 1:
                found.setdefault((2 * s, True), tuple(by_size[s][:2]))
            for t in kinds[:k]:
                found.setdefault((s + t, True), (by_size[s][0], by_size[t][0]))
        return found

    def _enter(self, b: int) -> None:
        if not 0 < self.fill[b] < self.length:
            return
        for size, pair in self.parts[b]:
            key = (size, pair, self.fill[b])
            at = self.lines.get(key)
            if at is None:
                at = self.lines[key] = len(self.members)
                if at == len(self.size):
                    self.size, self.pair, self.full, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.pair, self.full, self.count))
                self.size[at], self.pair[at], self.full[at] = key
                self.members.append({})
            self.members[at][b] = None
            self.count[at] += 1

    def _leave(self, b: int) -> None:
        if 0 < self.fill[b] < self.length:
            for size, pair in self.parts[b]:
                at = self.lines[size, pair, self.fill[b]]
                del self.members[at][b]
                self.count[at] -= 1

    def step(self, low: int) -> int | None:
        """Makes the move or exchange that raises the sum of squared fills most by filling another bin from this one; returns that bin."""
        self._leave(low)
        used = len(self.members)
        live = np.flatnonzero((self.count[:used] > 0) & (self.full[:used] >= self.fill[low]))
        best, found = 0, None
        if len(live):
            size, pair, full = self.size[live], self.pair[live], self.full[live]
            room, ahead = self.length - full, full - self.fill[low]
            for (given, given_pair), pieces in self.parts[low].items():
                gain = given - size
                good = (gain > 0) & (gain <= room)
                if given_pair:
                    good &= ~pair  # two for one or none
                worth = np.where(good, gain * (ahead + gain), 0)
                k = int(worth.argmax())
                if worth[k] > best:
                    best, found = int(worth[k]), (int(live[k]), pieces, int(gain[k]))
        if found is None:
            self._enter(low)
            return None
        line, give, gain = found
        full_bin = next(iter(self.members[line]))
        take = self.parts[full_bin][int(self.size[line]), bool(self.pair[line])]
        self._leave(full_bin)
        for b, out, into, change in ((full_bin, take, give, gain), (low, give, take, -gain)):
            self.bins[b] = [i for i in self.bins[b] if i not in out] + list(into)
            self.fill[b] += change
            self.parts[b] = self._parts(b)
            self._enter(b)
        return full_bin


def improve(bins: list[list[int]], sizes: list[int], length: int) -> list[list[int]]:
    """Local search over underfull bins: moves and exchanges of one for one, two for one and one for two between any two of them, as long as one raises
    the sum of squared fills; it stops early only at the least number of bins there can be. The emptiest bin gives first."""
    least = -(-sum(sizes) // length)
    if len(bins) <= least:
        return bins
    state = _Open(bins, sizes, length)
    alive, changed = len(bins), True
    while changed and alive > least:
        changed = False
        heap = [(int(f), b) for b, f in enumerate(state.fill) if 0 < f < length]
        heapify(heap)
        while heap and alive > least:
            fill, low = heappop(heap)
            if fill != state.fill[low]:
                continue
            while state.fill[low] and (full := state.step(low)) is not None:
                changed = True
                if state.fill[full] < length:
                    heappush(heap, (int(state.fill[full]), full))
            alive -= not state.fill[low]
    return [b for b in state.bins if b]


PACKED = f"{PIECES}, sequence_id long, offset long, open boolean"


def _packer(length: int, level: int):
    def pack_group(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_pylist()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), table.column("ids_crc32").to_numpy()))
        order = order.tolist()  # rows of a group arrive in any order; packing must not depend on it
        arranged = [sizes[i] for i in order]
        bins = improve(best_fit(arranged, length), arranged, length)
        sequence, offset, open_ = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        first = level << 56 | (table.column("grp")[0].as_py() if len(sizes) else 0) << 24
        for s, b in enumerate(bins):
            at = 0
            for k in b:
                sequence[order[k]], offset[order[k]] = first + s, at
                at += arranged[k]
            if at <= REOPEN * length:
                open_[[order[k] for k in b]] = True
        columns = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table([*(table.column(c) for c in columns), pa.array(sequence), pa.array(offset), pa.array(open_)], names=[*columns, "sequence_id", "offset", "open"])

    return pack_group


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rest, done, level = staged(pieces(docs, tokenizer_path, length, end_id, id_col, text_col)), None, 0
    n = rest.count()
    while True:
        groups = max(1, -(-n // group_pieces))
        # By the row's place in the staged files: rows that repeat id and text are dealt out, too.
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        packed = dealt.groupBy("grp").applyInArrow(_packer(length, level), PACKED)
        left = 0
        if groups > 1:
            packed = staged(packed)
            left = packed.where("open").count()
        again = 0 < left <= n // 2  # bins that many groups left part-filled are packed once more, together
        part = (packed.where("NOT open") if again else packed).drop("open")
        done = part if done is None else done.unionByName(part)
        if not again:
            return done
        rest, n, level = packed.where("open").drop("sequence_id", "offset", "open"), left, level + 1
