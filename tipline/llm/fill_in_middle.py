"""Fill-in-middle transformation by rank and select.

A slice of documents becomes two packed bitvectors: where a token starts and where a code point starts. Blocks of 512 bits have their popcounts summed up
in a directory. The popcount between a document's bounds is its number of tokens, select finds the bytes of the two cuts, and rank counts code points.
Nothing is shuffled; a task holds one slice of texts and an eighth of its size in each bitvector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import slices, text_of

#: Shares of h3 % 100 and h4 % 100: from PLAIN_FROM on a text stays plain, below SPM_BELOW the suffix comes first.
PLAIN_FROM, SPM_BELOW = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES, STEP = 4 << 20, 1 << 20
BLOCK_WORDS = 8

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Bits:
    """A packed bitvector with a directory of block popcounts."""

    def __init__(self, packed: np.ndarray, n: int):
        words = -(-n // 64) + 1
        words += -words % BLOCK_WORDS
        raw = np.zeros(words * 8, np.uint8)
        raw[: len(packed)] = packed
        self.blocks = raw.view(np.uint64).reshape(-1, BLOCK_WORDS)
        self.counts = np.bitwise_count(self.blocks).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts.sum(1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at >> 9, at >> 6 & 7, (at & 63).astype(np.uint64)
        whole = np.where(np.arange(BLOCK_WORDS) < word[:, None], self.counts[block], 0).sum(1)
        cut = self.blocks[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(cut)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, counted from 0."""
        block = np.searchsorted(self.before, k, "right") - 1
        upto = np.cumsum(self.counts[block], axis=1)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(1)
        left = left - np.where(word > 0, upto[np.arange(len(k)), word - 1], 0)
        bits = np.unpackbits(self.blocks[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 512 + word * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) > left[:, None]).argmax(1)


def bitvectors(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Token starts and code-point starts of documents that begin at the given bytes: a run of letters is a token, and so is every other code point."""
    tokens, points = [], []
    for at in range(0, len(data), STEP):  # the unpacked form exists for one step only
        part = data[at : at + STEP]
        letter, point = _LETTER[part], part & 0xC0 != 0x80
        first = point.copy()
        first[1:] &= ~(letter[1:] & letter[:-1])
        if at:
            first[0] &= not (letter[0] and _LETTER[data[at - 1]])
        first[starts[(starts >= at) & (starts < at + len(part))] - at] = True
        tokens.append(np.packbits(first, bitorder="little"))
        points.append(np.packbits(point, bitorder="little"))
    empty = [np.zeros(0, np.uint8)]
    return Bits(np.concatenate(tokens or empty), len(data)), Bits(np.concatenate(points or empty), len(data))


def _parts(texts: pa.Array, h: np.ndarray) -> dict[str, pa.Array]:
    """The columns of one slice; h has a row of four numbers for each text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    tokens, points = bitvectors(np.frombuffer(raw, np.uint8), bounds[:-1][bounds[:-1] < bounds[-1]])
    ranks = tokens.rank(bounds)
    n = np.diff(ranks)
    plain = (n == 0) | pc.match_substring_regex(texts, "<[PSM]>").to_numpy(zero_copy_only=False) | (h[:, 2] % 100 >= PLAIN_FROM)
    suffix_first = h[:, 3] % 100 < SPM_BELOW
    units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cuts = np.repeat(bounds[1:, None], 2, axis=1)
    inside = units < n[:, None]
    cuts[inside] = tokens.select((ranks[:-1, None] + units)[inside])
    marks = points.rank(np.column_stack([bounds[:-1], cuts]).ravel()).reshape(-1, 3)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    made = []
    for a, (b, c), d, as_is, spm in zip(bounds[:-1].tolist(), cuts.tolist(), bounds[1:].tolist(), plain.tolist(), suffix_first.tolist(), strict=True):
        made.append(bytes(raw[a:d]) if as_is else b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c]) if spm else (p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    return {
        "n": pa.array(n),
        "form": pa.array(np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))),
        "prefix_chars": pa.array(marks[:, 1] - marks[:, 0], mask=plain),
        "middle_chars": pa.array(marks[:, 2] - marks[:, 1], mask=plain),
        "output": pa.array(made, pa.binary()).cast(pa.string()),
    }


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            h = np.column_stack([part.column(k).to_numpy() for k in (2, 3, 4, 5)])
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | _parts(part.column(1), h))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (the whole transformed text).

    The cuts come from the id alone. A null text counts as empty and stays plain, as does a text that has a marker in it; a null id counts as the empty
    string. Rows that repeat an id are cut each for itself. Other columns of docs are not read.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *numbers)
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(_transformed, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that transform was given, from what it returned. A text with markers of its own is always plain, so each marker stands once."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def halves(marker: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, marker, 1), F.lit(1 + len(marker))), F.substring_index(head, marker, -1)

    prefix, suffix = halves(SUFFIX)
    last, first = halves(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(first, middle, last))
