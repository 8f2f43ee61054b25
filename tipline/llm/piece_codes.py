"""Encoding and decoding by a merge-type piece model (BPE of the sentencepiece format).

Of all pieces that end at a place of a text, exactly one is the last piece of the encoding of that prefix: the one whose own encoding is itself and that
agrees with the last piece of the prefix before it, that is, the two written together are encoded as these two. So one pass with an automaton over all
pieces fills a table of last pieces, and the ids are read off it from the end. No queue of merges is needed, and time grows with the text's length.

A text is cut first wherever no piece has both bytes beside the cut: nothing is merged across. The parts repeat a lot; each task keeps the ids of parts it
has met. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import slices, text_of

#: How a model writes a space.
SPACE_MARK = "▁"
UNKNOWN_TEXT = " ⁇ "
REPLACEMENT = "�".encode()
SLICE_BYTES = 2 << 20
#: Parts of a text and pairs of pieces that a task remembers; both only save time.
KNOWN_PARTS, KNOWN_PAIRS, LONGEST_KNOWN = 200_000, 500_000, 64

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model(NamedTuple):
    """Pieces in the order of their ids, their scores and kinds."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]


def load(path: str) -> Model:
    """Reads a model file. Only models of this form are supported: type BPE, text as it is with one space put before it, bytes for unknown characters."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    found = proto.ModelProto()
    with open(path, "rb") as f:
        found.ParseFromString(f.read())
    rules, trained = found.normalizer_spec, found.trainer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    kinds = [p.type for p in found.pieces]
    if trained.model_type != trained.BPE or not plain or not trained.byte_fallback or trained.treat_whitespace_as_suffix or {USER_DEFINED, UNUSED} & set(kinds):
        raise ValueError(f"{path}: not a BPE model with byte fallback, identity rules and a space before the text")
    return Model([p.piece for p in found.pieces], [p.score for p in found.pieces], kinds)


class Encoder:
    """Encodes texts; one for each task."""

    def __init__(self, model: Model):
        self.pieces = model.pieces
        self.byte_ids = np.zeros(256, np.int64)
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
        self.byte_ids = self.byte_ids.tolist()
        normal = {piece: i for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
        self.cost = {piece: -model.scores[i] for piece, i in normal.items()}
        self.sizes = [len(p) for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        self.joined = np.zeros((256, 256), bool)
        self.bigrams = set()
        for piece, i in normal.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:  # others come up in no encoding
                self.automaton.add_word(piece, i)
                raw = np.frombuffer(piece.replace(SPACE_MARK, " ").encode(), np.uint8)
                self.joined[raw[:-1], raw[1:]] = True
                self.bigrams.update(zip(piece, piece[1:], strict=False))
        self.automaton.make_automaton()
        self.joined[:, 0x80:0xC0] = True  # no cut inside a character
        self.pairs, self.parts = {}, {}

    def merged(self, text: str) -> list[str]:
        """Merges one short string by the rule itself: the best-scored pair first, the leftmost of equals."""
        parts, cost = list(text), self.cost
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                c = cost.get(parts[k] + parts[k + 1])
                if c is not None and (best is None or c < best):
                    best, at = c, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, left: int | str, right: int) -> bool:
        """Whether two neighbours stay apart; left is an id, or a character that is no piece."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b = left if isinstance(left, str) else self.pieces[left], self.pieces[right]
            known = (a[-1], b[0]) not in self.bigrams or self.merged(a + b) == [a, b]
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def encoded(self, part: str) -> tuple[int, ...]:
        """The ids of a part of a text, by the table of last pieces."""
        last: list[int | None] = [None] * (len(part) + 1)
        sizes, pairs = self.sizes, self.pairs
        for end, piece in self.automaton.iter(part):
            end += 1
            if last[end] is None:
                start = end - sizes[piece]
                if start:
                    before = last[start]
                    if before is None:
                        before = part[start - 1]  # no piece ends there: the character itself is the last one
                    known = pairs.get((before, piece))
                    if not (self.agree(before, piece) if known is None else known):
                        continue
                last[end] = piece
        ids, end = [], len(part)
        while end:
            piece = last[end]
            if piece is None:
                end -= 1
                ids.extend(self.byte_ids[b] for b in reversed(part[end].encode()))
            else:
                ids.append(piece)
                end -= sizes[piece]
        ids.reverse()
        return tuple(ids)

    def _of(self, part: bytes) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.encoded(part.decode().replace(" ", SPACE_MARK))
            if len(part) <= LONGEST_KNOWN:
                if len(self.parts) >= KNOWN_PARTS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin and end."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE_MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined[data[:-1], data[1:]]
        cut[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        found = [self._of(p) for p in parts.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        codes = parts.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[codes])])
        return ids[spread((np.cumsum(sizes) - sizes)[codes], sizes[codes])], upto[np.searchsorted(starts, offsets)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] places, then the same for all others."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def _character(raw: bytes) -> int:
    """Bytes of the UTF-8 character that raw begins with, 0 if there is none."""
    for n in range(1, min(4, len(raw)) + 1):
        try:
            raw[:n].decode()
            return n
        except UnicodeDecodeError:
            pass
    return 0


def _repaired(raw: bytes) -> bytes:
    """Bytes that a run of byte pieces stands for: each byte that begins no character becomes a replacement character."""
    out, at = [], 0
    while at < len(raw):
        n = _character(raw[at : at + 4])
        out.append(raw[at : at + n] if n else REPLACEMENT)
        at += n or 1
    return b"".join(out)


class Decoder:
    """Turns ids into texts; one for each task."""

    def __init__(self, model: Model):
        surface = {NORMAL: lambda p: p.replace(SPACE_MARK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_TEXT.encode()}
        self.raw = [surface[k](p) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.kinds = np.array(model.kinds)
        self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE_MARK) for p, k in zip(model.pieces, model.kinds, strict=True)])
        self.unknown = model.kinds.index(UNKNOWN)

    def _slowly(self, ids: np.ndarray) -> bytes:
        """One text that has bytes which are no characters: runs of byte pieces are repaired one by one."""
        out, run = [], []
        for i in ids.tolist():
            if self.kinds[i] == BYTE:
                run.append(self.raw[i])
            else:
                out += [_repaired(b"".join(run)), self.raw[i]]
                run = []
        return b"".join([*out, _repaired(b"".join(run))])

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> Iterable[str]:
        ids = np.where((ids < 0) | (ids >= len(self.sizes)), self.unknown, ids)
        sizes = self.sizes[ids]
        data = self.data[spread(self.starts[ids], sizes)].tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes)])
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        firsts = np.searchsorted(shown, bounds[:-1])
        for k, first in enumerate(firsts.tolist()):
            a, b = bounds[k], bounds[k + 1]
            if first == len(shown) or shown[first] >= b:
                yield ""
                continue
            skip = int(self.spaced[ids[shown[first]]])  # the space put before the text
            raw = data[upto[a] : upto[b]]
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = self._slowly(ids[a:b]).decode()
            yield text[skip:]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text, without begin and end ids.

    A null text counts as empty and has no ids. The model is read by the driver; its size is fixed. Rows that repeat an id stay apart; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, bounds = encoder(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text that every row's ids stand for.

    Null ids give the empty text, null entries are left out, numbers that are no id count as unknown; bytes that are no character become U+FFFD.
    """
    model = coded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            groups = np.cumsum(sizes * 4) // SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                lists = batch.column(1).slice(a, b - a)
                texts = decoder(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes[a:b])]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    ids = F.filter(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("ids")
    return coded.select(F.col(id_col).alias("doc_id"), ids).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
