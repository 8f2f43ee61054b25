"""Words of many texts at once: 64-bit hashes, word ends and document bounds, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tipline.llm.common import SPACE_BYTES

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def mixed(h: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Spreads a hash over all 64 bits, together with a second number where given."""
    h = h * MIX[0] if other is None else h * MIX[0] ^ (other.astype(np.uint64) + MIX[3]) * MIX[1]
    h = (h ^ h >> np.uint64(32)) * MIX[2]
    h = (h ^ h >> np.uint64(29)) * MIX[3]
    return h ^ h >> np.uint64(32)


class Slice(NamedTuple):
    """Documents first..last-1 of an array: the bytes, where each word starts and ends, its hash, and the documents' bounds in words."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


class Words:
    """A word's hash is a polynomial over random values of its bytes (A-Z as a-z), read off running sums."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, slice_bytes: int = 3 << 20):
        self.slice_bytes = slice_bytes
        self.value = np.random.default_rng(7).integers(1 << 63, (1 << 64) - 1, 256, np.uint64, endpoint=True)
        self.value[65:91] = self.value[97:123]
        self.space = np.isin(np.arange(256), np.frombuffer(SPACE_BYTES, np.uint8))
        self.up = self.down = np.ones(0, np.uint64)

    def slices(self, texts: pa.Array) -> Iterator[Slice]:
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.slice_bytes, "right")) - 1)
            yield self._of(at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end

    def _of(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> Slice:
        n = len(data)
        if n > len(self.up):
            size = max(n, self.slice_bytes)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        space = self.space[data]
        opens, closes = np.ones(n, bool), np.ones(n, bool)
        opens[1:], closes[:-1] = space[:-1], space[1:]
        opens[offsets[offsets < n]] = True
        closes[offsets[offsets > 0] - 1] = True
        starts, ends = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts])
        return Slice(first, last, data, starts, ends, hashes, np.searchsorted(starts, offsets))
