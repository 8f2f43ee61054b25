"""Product codes of vectors: exact integer k-means for each of four parts, assigned by exponion search.

A part starts at the entry that it had in the round before, at squared distance D. An entry that is no farther away lies within twice that distance of this
entry (triangle inequality), so it stands among the first places of the entry's list of neighbours, sorted by distance: those at squared distance up to 4 D.
The list is scanned block by block; a nearer entry at squared distance E shrinks the radius to (sqrt(D) + sqrt(E))^2. All comparisons that decide are between
integers, ties go to the lower index, so the result does not depend on how the rows are dealt out.

Each round reads the staged rows (integer parts and codes) and writes them with new codes; sums and counts are arrays of fixed size that tasks build and two
levels of groups add up. The driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import dropped, sized, staged, summed

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Neighbours scanned before the radius is looked at again, and rows assigned at a time.
BLOCK, ROWS = 64, 32_768
#: Copies of the label sums that meet the rows of a label where labels are too many to broadcast.
SALTS = 64
EXACT = 1 << 53
LONG_MAX = (1 << 63) - 1


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with integer components, little-endian 32-bit, saturated; rows with null or non-finite components go."""
    for batch in batches:
        vectors = batch.column(2)
        values = vectors.flatten()
        sizes = pc.list_value_length(vectors).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        keep = np.flatnonzero(bad[bounds[1:]] == bad[bounds[:-1]])
        limit = np.iinfo(np.int32).max
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.clip(np.floor(x * SCALE), -limit, limit)
        whole = np.nan_to_num(whole).astype("<i4")
        parts = pa.array([whole[a:b].tobytes() for a, b in zip(bounds[keep].tolist(), bounds[keep + 1].tolist(), strict=True)], pa.binary())
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), parts], names=["vec_id", "label", "parts"])


def most(width: int) -> int:
    """Largest magnitude of a component with which the squared distance of two vectors of that many components is below 2^63."""
    return int(np.sqrt(2.0**63 / (4 * max(1, width)))) - 1


def matrix(parts: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; short vectors end in zeros."""
    raw = parts.to_pylist()
    if all(len(r) == 4 * width for r in raw):
        out = np.frombuffer(b"".join(raw), "<i4").reshape(-1, width)
    else:
        out = np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in raw), "<i4").reshape(-1, width)
    return np.clip(out.astype(np.int64), -most(width), most(width))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, exact. Floating point is used only where every number on the way is an integer below 2^53."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - y[:, k]
        out += gap * gap
    return out


class Book:
    """One codebook with every entry's list of neighbours, sorted by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = distances(entries, entries)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, the lower index of equals; start is the entry to search from."""
        index, distance = start.copy(), ((x - self.entries[start]) ** 2).sum(1)
        by_start = np.argsort(start, kind="stable")
        edges = np.searchsorted(start[by_start], np.arange(len(self.entries) + 1))
        for entry in range(len(self.entries)):
            rows = by_start[edges[entry] : edges[entry + 1]]
            if len(rows):
                self._scan(entry, rows, x[rows], index, distance)
        return index, distance

    def _scan(self, entry: int, rows: np.ndarray, x: np.ndarray, index: np.ndarray, distance: np.ndarray) -> None:
        first = distance[rows].astype(np.float64)
        at = np.arange(len(rows))
        for low in range(0, len(self.entries), BLOCK):
            # (sqrt(D) + sqrt(E))^2, rounded up by more than floating point can lose: at the start, E is D.
            found = distance[rows[at]].astype(np.float64)
            radius = (first[at] + found + 2 * np.sqrt(first[at] * found)) * (1 + 1e-9) + 1
            at = at[self.apart[entry, low] <= radius]
            if not len(at):
                return
            near = self.order[entry, low : low + BLOCK]
            d = distances(x[at], self.entries[near])
            least = d.min(1)
            which = np.where(d == least[:, None], near, len(self.entries)).min(1)
            r = rows[at]
            better = (least < distance[r]) | (least == distance[r]) & (which < index[r])
            index[r[better]], distance[r[better]] = which[better], least[better]


def _codes(batch: pa.RecordBatch, k: int, n: int) -> np.ndarray:
    raw = batch.column(k).to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").reshape(n, PARTS).astype(np.int64)


def _assigned(books: np.ndarray, width: int, first: bool, final: bool):
    """vec_id, label, parts (and codes, unless this is the first search) to the same with new codes; or, at the end, to codes as text and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Book(b) for b in books]
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                n = part.num_rows
                x = matrix(part.column(2), width).reshape(n, PARTS, width // PARTS)
                before = np.zeros((n, PARTS), np.int64) if first else _codes(part, 3, n)
                found = [made[p].nearest(np.ascontiguousarray(x[:, p]), before[:, p]) for p in range(PARTS)]
                codes = np.stack([f[0] for f in found], axis=1)
                if final:
                    text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])
                else:
                    packed = pa.array([row.tobytes() for row in codes.astype("<u2")], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], names=["vec_id", "label", "parts", "codes"])

    return run


def _sums(entries: int, width: int):
    """For each part and entry the number of parts assigned and their componentwise sums."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((PARTS, entries, 1 + width // PARTS), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                n = part.num_rows
                x, codes = matrix(part.column(0), width).reshape(n, PARTS, width // PARTS), _codes(part, 1, n)
                for p in range(PARTS):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, starts = np.unique(codes[order, p], return_index=True)
                    total[p, used, 0] += np.diff(np.append(starts, n))
                    total[p, used, 1:] += np.add.reduceat(x[order, p], starts, axis=0)
        return total.ravel()

    return build


def _first_books(rows: DataFrame, width: int, entries: int) -> np.ndarray:
    """The parts of the rows with the smallest ids; of rows that repeat an id, the smallest in bytes first."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").toArrow()["parts"].combine_chunks()
    return np.ascontiguousarray(matrix(seeds, width).reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows of vec_id, label, code (two hex digits for each part; entries is at most 256), error, and the final codebooks as [part, entry, component].

    Rows whose vector is null or has null or non-finite components go; all others stay, also those that repeat an id. Vectors shorter than the longest, rounded
    up to a multiple of four, end in zeros. Integers beyond what distances in 63 bits allow (beyond 10^8 at 64 components) are set to that bound. Fewer rows than
    entries give as many entries as there are rows; an empty table gives no rows and empty codebooks. Null ids come last where ids are ordered.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: entries must be 1 to 256")
    types = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, label {vectors.schema[label_col].dataType.simpleString()}"
    source = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = staged(source.mapInArrow(_integers, f"{types}, parts binary"))
    bytes_ = rows.agg(F.max(F.length("parts"))).first()[0] or 0
    width = max(PARTS, -(-bytes_ // 4 // PARTS) * PARTS)
    books = _first_books(rows, width, entries)
    if not books.size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    for number in range(rounds):
        before, rows = rows, staged(rows.mapInArrow(_assigned(books, width, number == 0, False), f"{types}, parts binary, codes binary"))
        dropped(before)
        total = summed(rows.select("parts", "codes"), _sums(books.shape[1], width), np.add).reshape(*books.shape[:2], 1 + width // PARTS)
        count, used = np.maximum(total[:, :, :1], 1), total[:, :, :1] > 0
        books = np.where(used, total[:, :, 1:] // count, books)
    done = staged(rows.mapInArrow(_assigned(books, width, rounds == 0, True), f"{types}, code string, error long"))
    dropped(rows)
    return done, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over the rows of the same label, nulls together; sums beyond a long are the largest long."""
    key = F.xxhash64("label")  # for the shuffle; the label itself decides
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = staged(coded.groupBy("label").agg(total.alias("label_error")).select(key.alias("k"), F.col("label").alias("same"), "label_error"))
    small = sized(sums)
    rows = coded.withColumn("k", key)
    if small is sums:  # too many labels to broadcast: rows of a frequent one are dealt out over salts
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        small = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        on = (rows["k"] == small["k"]) & (rows["salt"] == small["salt"]) & rows["label"].eqNullSafe(small["same"])
    else:
        on = (rows["k"] == small["k"]) & rows["label"].eqNullSafe(small["same"])
    return rows.join(small, on).select("vec_id", "label", "code", "error", "label_error")
