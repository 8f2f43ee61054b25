"""Language identification with language-bitmask n-gram filters.

Learning takes a bounded sample of labelled documents per language (SAMPLE_DOCS, drawn by a hash of the id), counts byte n-grams of
lower-cased letters, and keeps the n-grams that make up at least MIN_SHARE of their language's, so at most 1 / MIN_SHARE per
language. They go into a bit-sliced Bloom filter: each slot is a bit mask over languages, and the bitwise and of an n-gram's slots
gives all languages that contain it, in one look-up. A document's n-grams are counted per language by the bits of their masks;
each count is corrected for the language's false-positive rate and set against what the language's own documents reach. The
largest one decides.

Defined results: a null text, or one without a letter, is `und` with score 0; a text none of whose n-grams is known gets the
language with most documents and score 0, as does every text if one language only was learned; without labelled documents all
are `und`. Rows are independent, so repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import crc_bucket, slices, staged, summed, trimmed

#: Bytes of an n-gram; least share of a language's n-grams; labelled documents learned from per language (about).
GRAM, MIN_SHARE, SAMPLE_DOCS = 5, 1e-5, 4000
#: log2 of the filter's slots, and hash functions. The filter takes 2^SLOT_BITS bits for each language, whatever their number.
SLOT_BITS, HASHES = 20, 2
#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _letters() -> np.ndarray:
    """Byte to byte: A-Z to a-z, other ASCII that is no letter to a space, the rest as it is."""
    table = np.arange(256, dtype=np.uint64)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


class Grams:
    """The n-grams of the texts of an Arrow array: hashes, and the number of each text's."""

    def __init__(self, gram: int = GRAM):
        self.gram, self.table = gram, _letters()

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = [b" " + (t or b"") + b" " for t in texts.cast(pa.binary()).to_pylist()]
        sizes = np.array([len(t) for t in raw], np.int64)
        b = self.table[np.frombuffer(b"".join(raw), np.uint8)]
        # Runs of spaces count as one: a byte stays unless it and the one before are spaces.
        first = np.zeros(len(sizes), np.int64)
        first[1:] = np.cumsum(sizes)[:-1]
        stays = np.ones(len(b), bool)
        stays[1:] = (b[1:] != 32) | (b[:-1] != 32)
        stays[first] = True
        upto = np.zeros(len(b) + 1, np.int64)
        np.cumsum(stays, out=upto[1:])
        sizes = upto[first + sizes] - upto[first]
        b = b[stays]
        n = max(0, len(b) - self.gram + 1)
        code = np.zeros(n, np.uint64)
        for k in range(self.gram):
            code |= b[k : k + n] << np.uint64(8 * k)
        counts = np.maximum(sizes - self.gram + 1, 0)
        starts = np.zeros(len(sizes), np.int64)
        starts[1:] = np.cumsum(sizes)[:-1]
        inside = np.zeros(len(b) + 1, np.int32)
        np.add.at(inside, starts[counts > 0], 1)
        np.add.at(inside, (starts + counts)[counts > 0], -1)
        code = code[np.cumsum(inside)[:n] > 0]
        code *= _ODD[0]
        code ^= code >> np.uint64(32)
        return code * _ODD[1], counts


def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (h * _ODD[2 + k % 2] + np.uint64(k)) >> np.uint64(64 - SLOT_BITS)


class Filter:
    """Bit-sliced Bloom filter over the learned languages."""

    def __init__(self, table: np.ndarray, languages: list[str], reach: np.ndarray | None = None):
        self.table, self.languages = table, languages
        bit = [np.uint64(k % 64) for k in range(len(languages))]
        self.columns = [(k // 64, b) for k, b in enumerate(bit)]
        fill = np.array([((table[:, w] >> b) & np.uint64(1)).mean() for w, b in self.columns])
        self.wrong = fill**HASHES
        self.reach = np.ones(len(languages)) if reach is None else reach

    def shares(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Text x language: corrected share of the text's n-grams that the language has."""
        masks = None
        for s in _slots(h):
            masks = self.table[s] if masks is None else masks & self.table[s]
        edges = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=edges[1:])
        out = np.zeros((len(counts), len(self.languages)))
        for k, (w, b) in enumerate(self.columns):
            sums = np.zeros(len(h) + 1, np.int64)
            np.cumsum((masks[:, w] >> b) & np.uint64(1), out=sums[1:])
            hits = sums[edges[1:]] - sums[edges[:-1]]
            out[:, k] = np.maximum(0, (hits - counts * self.wrong[k]) / (1 - min(self.wrong[k], 0.999999)))
        return out / np.maximum(counts, 1)[:, None]


def _counted(gram: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(gram)
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                languages = np.array(batch.column(0).to_pylist(), object)
                for lang in set(languages.tolist()):
                    h, _ = grams.of(batch.column(1).filter(pa.array(languages == lang)))
                    values, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    return counted


def _filled(languages: list[str]):
    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        index = {lang: k for k, lang in enumerate(languages)}
        table = np.zeros((1 << SLOT_BITS, -(-len(languages) // 64)), np.uint64)
        for batch in batches:
            k = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in _slots(h):
                np.bitwise_or.at(table, (s.astype(np.int64), k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        return table.ravel()

    return build


def _reached(model: Filter, gram: int):
    """Sums of each language's own share over its sample, and their number."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        grams, total = Grams(gram), np.zeros((2, len(model.languages)))
        index = {lang: k for k, lang in enumerate(model.languages)}
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                h, counts = grams.of(batch.column(1))
                k = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
                own = model.shares(h, counts)[np.arange(len(k)), k]
                np.add.at(total[0], k[counts > 0], own[counts > 0])
                np.add.at(total[1], k[counts > 0], 1)
        return total.ravel()

    return build


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, min_share: float = MIN_SHARE, gram: int = GRAM) -> Filter | None:
    """labelled: draw (long, the hash that sampling goes by), lang, text; rows without lang or text are left out."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").collect()  # one row per language
    if not sizes:
        return None
    languages = [r["lang"] for r in sizes]
    # A hash below the language's threshold: about sample_docs documents of each, all of a rarer one.
    limits = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_docs / r["count"])))])
    sample = staged(labelled.where(F.pmod("draw", F.lit(1 << 30)) < limits[F.col("lang")] * (1 << 30)).select("lang", "text"))
    counts = sample.mapInArrow(_counted(gram), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    counts = staged(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").where(F.col("n") >= F.col("total") * min_share).select("lang", "h")
    table = summed(kept, _filled(languages), np.bitwise_or).reshape(1 << SLOT_BITS, -1)
    model = Filter(table, languages)
    reached = summed(sample, _reached(model, gram), np.add).reshape(2, -1)
    return Filter(table, languages, np.maximum(reached[0] / np.maximum(reached[1], 1), 1e-3))


def _predicted(model: Filter | None, gram: int):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(gram)
        for whole in batches:
            for batch in slices(whole, 0, SLICE_BYTES):
                lettered = np.array([any(map(str.isalpha, t or "")) for t in batch.column(0).to_pylist()], bool)
                pred = np.full(batch.num_rows, "und", object)
                score, known = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                n_grams = np.zeros(batch.num_rows, np.int64)
                if model is not None and lettered.any():
                    h, counts = grams.of(batch.column(0))
                    shares, n_grams = model.shares(h, counts), np.asarray(counts, np.int64)
                    fit = shares / model.reach
                    best = fit.argmax(1)
                    rows = np.arange(len(best))
                    rest = fit.sum(1) - fit[rows, best]
                    pred = np.where(lettered, np.array(model.languages, object)[best], "und")
                    top = fit[rows, best]
                    score = np.where(lettered & (top > 0), np.clip((top - rest / max(1, fit.shape[1] - 1)) / np.maximum(top, 1e-9), 0, 1), 0.0)
                    known = np.where(lettered, np.clip(shares[rows, best], 0, 1), 0.0)
                others = [batch.column(k) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(known), pa.array(n_grams)], names=[*batch.schema.names[1:], "lang_pred", "score", "known", "n_grams"])

    return predicted


def identify(docs: DataFrame, model: Filter | None, text: Column, keep: Column, gram: int = GRAM) -> DataFrame:
    """keep (any one column), lang_pred, score (0 to 1, how far the language stands above the others) known (share of the n-grams it has) and n_grams."""
    source = docs.select(text.cast("string").alias("text"), keep.alias("keep"))
    kind = source.schema["keep"].dataType.simpleString()
    return source.mapInArrow(trimmed(_predicted(model, gram)), f"keep {kind}, lang_pred string, score double, known double, n_grams long")


def learned(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter | None:
    """Learns from the documents whose crc32 of the id, modulo folds, is not 0."""
    rows = docs.where(crc_bucket(id_col, folds) != 0)
    return learn(rows.select(F.xxhash64(F.col(id_col).cast("string"), F.lit("draw")).alias("draw"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))


def predict(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, known."""
    model = learned(docs, folds, id_col, text_col, lang_col)
    keep = F.struct(F.col(id_col).alias("doc_id"), (crc_bucket(id_col, folds) == 0).alias("held_out"))
    return identify(docs, model, F.col(text_col), keep).select("keep.doc_id", "keep.held_out", "lang_pred", "score", "known")
