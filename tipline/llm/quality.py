"""Quality scores by co-training: a classifier of the text's words and one of the page's metadata teach each other.

The text view sees hashed words and word shapes (length, capitals, last character). The metadata view sees what is known without reading the words: source,
language, and the page's size, number of words and share of line breaks, each as a bucket. Both are logistic regressions, fitted first on a bounded sample
of LABELLED labelled documents, drawn by a hash of the id. Then, in each round, either view scores all documents in their tasks and labels the share GROW
of them it is surest of (by confidences calibrated on labelled ones kept apart), in the proportions of the labelled ones; a histogram of confidences over all documents gives the thresholds.
The other view learns from these pseudo-labels in the tasks where the documents are: every task takes gradient steps over its own ones, and the
tasks' weights are averaged by their number. The driver then fits the labelled sample again, drawn to that average. A fifth of the labelled
sample is kept apart: each view is calibrated on it (Platt), and a last regression on both calibrated views gives the combined score. Every
document is then scored.

Defined results: null text is empty text; a null source or language is a value of its own; a document with several labels has their mean, rounded half
up; rows without a label or id do not teach; without labels of both kinds every score is 0.5; repeated rows get equal scores; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipline.llm.common import staged, summed
from tipline.llm.words import Slice, Words

#: Labelled documents that are learned from, at most (about).
LABELLED = 8000
#: Rounds, share of all documents that a view labels in a round, least confidence of a pseudo-label, and score from which a document is kept.
ROUNDS, GROW, SURE, KEEP = 3, 0.1, 0.9, 0.5
#: log2 of hashed words; codes of word shapes; codes of source, language and each layout figure.
WORD_BITS, SHAPES = 15, 16 * 3 * 34
SOURCES, LANGUAGES, STEPS, FIGURES = 1024, 64, 16, 3
STEPS_OF_FIT, PENALTY = 150, 1e-5
#: Confidence bins of the histogram; gradient steps on the documents of a slice, and their size; how strongly the labelled fit is drawn to the average of the tasks.
BINS, SLICE_STEPS, SLICE_RATE, PULL = 2000, 8, 0.3, 1e-4


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Views:
    """Features of the documents of a slice: (document, feature, value) of either view."""

    def __init__(self):
        byte = np.arange(256)
        self.upper = (byte >= 65) & (byte <= 90)
        self.digit = (byte >= 48) & (byte <= 57)
        self.letter = self.upper | (byte >= 97) & (byte <= 122) | (byte >= 128)
        self.stop = ~self.letter & ~self.digit & (byte > 32)
        # The last byte of a word: letter, digit, or which ASCII sign.
        self.last = np.where(self.letter, 0, np.where(self.digit, 1, 2 + byte % 32))

    def text(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(s.bounds)
        doc = np.repeat(np.arange(len(n)), n)
        capitals = np.concatenate([[0], np.cumsum(self.upper[s.data])])
        length = s.ends - s.starts
        high = capitals[s.ends] - capitals[s.starts]
        case = np.where(high == 0, 0, np.where((high == 1) & (length > 1), 1, 2))
        shape = (np.minimum(length, 15) * 3 + case) * 34 + self.last[s.data[s.ends - 1]]
        word = (s.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        value = 1 / np.sqrt(np.maximum(n, 1))[doc]
        return np.concatenate([doc, doc]), np.concatenate([word, (1 << WORD_BITS) + shape]), np.concatenate([value, value])

    def page(self, s: Slice, source: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n_docs = s.last - s.first
        n = np.diff(s.bounds)
        doc = np.repeat(np.arange(n_docs), n)
        # Figures over whole documents; white space around words counts by the document's own first and last word.
        size = np.bincount(doc, s.ends - s.starts, n_docs) + n
        lines = np.concatenate([[0], np.cumsum(s.data == 10)])
        breaks = np.zeros(n_docs)
        some = n > 0
        breaks[some] = (lines[s.starts[s.bounds[1:][some] - 1]] - lines[s.starts[s.bounds[:-1][some]]]) / size[some]
        figures = [np.log2(size + 1), np.sqrt(breaks) * 40, np.log2(n + 1)]
        steps = [np.clip(f.astype(np.int64), 0, STEPS - 1) + k * STEPS for k, f in enumerate(figures)]
        index = np.stack([FIGURES * STEPS + source, FIGURES * STEPS + SOURCES + language, *steps], 1)
        return np.repeat(np.arange(n_docs), index.shape[1]), index.ravel(), np.ones(index.size)


SIZES = ((1 << WORD_BITS) + SHAPES, FIGURES * STEPS + SOURCES + LANGUAGES)


def _views(batch: pa.RecordBatch, words: Words, views: Views) -> Iterator[tuple[Slice, list]]:
    """batch: text, source, language."""
    for s in words.slices(batch.column(0)):
        source, language = (batch.column(k).slice(s.first, s.last - s.first).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
        yield s, [views.text(s), views.page(s, source, language)]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, label, and for both views feature numbers and values of each document."""
    words, views = Words(), Views()
    for batch in batches:
        for s, found in _views(batch, words, views):
            n, columns = s.last - s.first, []
            for (doc, index, value), size in zip(found, SIZES, strict=True):
                key, inverse = np.unique(doc * size + index, return_inverse=True)
                offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * size).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(np.bincount(inverse, value, len(key)).astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([batch.column(3).slice(s.first, n), batch.column(4).slice(s.first, n), *columns], names=["draw", "label", "i0", "v0", "i1", "v1"])


class Sparse:
    """Rows of features, as one flat list."""

    def __init__(self, index, value, row, n: int):
        self.index, self.value, self.row, self.n = index, value, row, n

    @staticmethod
    def of(index: pa.Array, value: pa.Array) -> Sparse:
        sizes = np.diff(index.offsets.to_numpy())
        return Sparse(index.flatten().to_numpy(), value.flatten().to_numpy().astype(float), np.repeat(np.arange(len(sizes)), sizes), len(sizes))

    def take(self, chosen: np.ndarray) -> Sparse:
        """Rows where chosen is true, in order."""
        keep = chosen[self.row]
        return Sparse(self.index[keep], self.value[keep], (np.cumsum(chosen) - 1)[self.row[keep]], int(chosen.sum()))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index] * self.value, self.n) + weights[-1]


def fit(x: Sparse, y: np.ndarray, size: int, steps: int = STEPS_OF_FIT, penalty: float = PENALTY, towards: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by adaptive gradient steps over all rows; the last weight is the constant. The penalty draws to 0, or to given weights, where the fit starts."""
    goal = np.zeros(size + 1) if towards is None else towards
    w, square = goal.copy(), np.full(size + 1, 1e-8)
    for step in range(steps):
        wrong = (_sigmoid(x.logits(w)) - y) / max(1, x.n)
        g = np.append(np.bincount(x.index, wrong[x.row] * x.value, size), wrong.sum()) + penalty * (w - goal)
        square = 0.9 * square + 0.1 * g * g if step else g * g + 1e-12
        w -= 0.3 / (1 + 0.05 * step) * g / (np.sqrt(square) + 1e-6)
    return w


def _small_fit(columns: list[np.ndarray], y: np.ndarray, rounds: int = 100, pull: float = 1.0) -> np.ndarray:
    """Logistic regression on a few columns and a constant by damped Newton steps; weights are pulled towards equal shares."""
    x = np.stack([*columns, np.ones(len(y))], 1)
    prior = np.array([1 / len(columns)] * len(columns) + [0.0])

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + pull / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


class Model:
    """Weights of both views, their calibrations (slope, constant) and the combination (two weights, constant)."""

    def __init__(self, weights, calibrations, combination):
        self.weights, self.calibrations, self.combination = weights, calibrations, combination

    def scores(self, logits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = [c[0] * z + c[1] for z, c in zip(logits, self.calibrations, strict=True)]
        a, b, constant = self.combination
        return _sigmoid(a * views[0] + b * views[1] + constant), _sigmoid(views[0]), _sigmoid(views[1])


def thresholds(histogram: np.ndarray, n_low: float, n_high: float, sure: float = SURE) -> tuple[float, float]:
    """Confidences up to which, and from which, documents are labelled: about the wanted numbers of them, none less sure than asked. histogram: of equal bins of 0 to 1."""
    bins = len(histogram)
    low = int(np.searchsorted(np.cumsum(histogram), n_low, "right"))
    high = bins - int(np.searchsorted(np.cumsum(histogram[::-1]), n_high, "right"))
    # A bin that alone holds more than is wanted is taken whole: its documents are all alike.
    low, high = max(low, int(np.flatnonzero(histogram)[0]) + 1 if histogram.any() and n_low >= 1 else 0), min(high, int(np.flatnonzero(histogram)[-1]) if histogram.any() and n_high >= 1 else bins)
    return min(low / bins, 1 - sure), max(high / bins, sure)


def _logits(found: list, weights: list[np.ndarray], n: int) -> list[np.ndarray]:
    return [np.bincount(doc, w[index] * value, n) + w[-1] for (doc, index, value), w in zip(found, weights, strict=True)]


def _sure(found: list, teachers, n: int) -> list[np.ndarray]:
    """Calibrated confidence of both views in each document of a slice."""
    weights, calibrations = teachers.value
    return [_sigmoid(c[0] * z + c[1]) for z, c in zip(_logits(found, weights, n), calibrations, strict=True)]


def _confidences(teachers):
    """Of both views, over a task's documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        words, views, out = Words(), Views(), np.zeros((2, BINS), np.int64)
        for batch in batches:
            for s, found in _views(batch, words, views):
                for k, p in enumerate(_sure(found, teachers, s.last - s.first)):
                    out[k] += np.bincount(np.minimum((p * BINS).astype(np.int64), BINS - 1), minlength=BINS)
        return out.ravel()

    return build


def _taught(teachers, limits: list[tuple[float, float]]):
    """For each view: its weights after steps over the documents that the other view is sure of, times their number, and that number."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        words, views = Words(), Views()
        w = [x.copy() for x in teachers.value[0]]
        square, seen = [np.full(len(x), 1e-4) for x in w], [0, 0]
        for batch in batches:
            for s, found in _views(batch, words, views):
                n = s.last - s.first
                sure = _sure(found, teachers, n)
                for k in (0, 1):
                    p, (low, high) = sure[1 - k], limits[1 - k]
                    chosen = (p <= low) | (p >= high)
                    if not chosen.any():
                        continue
                    doc, index, value = found[k]
                    keep = chosen[doc]
                    x = Sparse(index[keep], value[keep], doc[keep], n)
                    for _ in range(SLICE_STEPS):
                        wrong = np.where(chosen, _sigmoid(x.logits(w[k])) - (p >= high), 0.0) / chosen.sum()
                        g = np.append(np.bincount(x.index, wrong[x.row] * x.value, len(w[k]) - 1), wrong.sum()) + PENALTY * w[k]
                        square[k] += g * g
                        w[k] -= SLICE_RATE * g / np.sqrt(square[k])
                    seen[k] += int(chosen.sum())
        return np.concatenate([np.append(x * c, c) for x, c in zip(w, seen, strict=True)])

    return build


def learn(source: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, grow: float = GROW, sure: float = SURE) -> Model | None:
    """source: text, source, language, doc_id. labels: doc_id, label."""
    broadcast = source.sparkSession.sparkContext.broadcast
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.floor(F.avg("label") + 0.5).cast("int").alias("label"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    n_labels = labels.count()
    if not n_labels:
        return None
    some = labels.where(draw < int(min(1.0, labelled / n_labels) * (1 << 30)))
    taught = source.where("doc_id IS NOT NULL").join(F.broadcast(some), "doc_id")  # as many ids as are drawn
    once = taught.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by(F.struct("text", "source", "language"), F.xxhash64("text", "source", "language")).alias("row"))
    sample = staged(once.select("row.text", "row.source", "row.language", draw.alias("draw"), "label"))
    types = "draw long, label int, i0 array<int>, v0 array<float>, i1 array<int>, v1 array<float>"
    rows = sample.mapInArrow(_sparse, types).toArrow().combine_chunks()  # a row per drawn id
    if not rows.num_rows:
        return None
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("draw", "ascending"), ("label", "ascending")]))
    views = [Sparse.of(*(rows.column(f"{c}{k}").combine_chunks() for c in "iv")) for k in (0, 1)]
    label, apart = rows.column("label").to_numpy(), rows.column("draw").to_numpy() // 7 % 5 == 0
    if len(set(label[~apart].tolist())) < 2:
        apart = np.zeros(len(label), bool)
    if len(set(label[~apart].tolist())) < 2:
        return None
    held = apart if len(set(label[apart].tolist())) == 2 else np.ones(len(label), bool)  # too few to keep some apart
    known, y = ~apart, label[~apart].astype(float)
    share = y.mean()
    weights = [fit(v.take(known), y, size) for v, size in zip(views, SIZES, strict=True)]
    of_held = label[held].astype(float)

    def calibrated(weights: list[np.ndarray]) -> list[np.ndarray]:
        return [_small_fit([v.take(held).logits(w)], of_held) for v, w in zip(views, weights, strict=True)]

    everything = source.select("text", "source", "language")
    for _ in range(rounds):
        current = broadcast((weights, calibrated(weights)))
        histogram = summed(everything, _confidences(current), np.add).reshape(2, -1)
        n = grow * histogram[0].sum()
        limits = [thresholds(h, n * (1 - share), n * share, sure) for h in histogram]
        total = summed(everything, _taught(current, limits), np.add)
        parts = np.split(total, [SIZES[0] + 2])
        if not any(p[-1] for p in parts):
            break
        weights = [fit(v.take(known), y, size, penalty=PULL, towards=p[:-1] / p[-1]) if p[-1] else w for v, size, p, w in zip(views, SIZES, parts, weights, strict=True)]
    logits, calibrations = [v.take(held).logits(w) for v, w in zip(views, weights, strict=True)], calibrated(weights)
    combination = _small_fit([c[0] * z + c[1] for z, c in zip(logits, calibrations, strict=True)], of_held)
    return Model(weights, calibrations, combination)


def _scored(model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, views, m = Words(), Views(), model.value
        for batch in batches:
            for s, found in _views(batch, words, views):
                n = s.last - s.first
                if m is None:
                    scores = [np.full(n, 0.5)] * 3
                else:
                    scores = m.scores(_logits(found, m.weights, n))
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(s.first, n), *map(pa.array, scores)], names=["doc_id", "score", "text_score", "meta_score"])

    return scored


def classify(
    docs: DataFrame, labels: DataFrame, keep: float = KEEP, labelled: int = LABELLED, rounds: int = ROUNDS, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_id_col: str = "doc_id", label_col: str = "quality",
) -> DataFrame:
    """One row per document: doc_id, score, text_score, meta_score (0 to 1) and kept."""

    def code(name: str, n: int):
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(n)).cast("int")

    source = docs.select(F.col(text_col).cast("string").alias("text"), code(source_col, SOURCES).alias("source"), code(lang_col, LANGUAGES).alias("language"), F.col(id_col).cast("long").alias("doc_id"))
    model = learn(source, labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")), labelled, rounds)
    scored = source.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, text_score double, meta_score double")
    return scored.withColumn("kept", F.col("score") >= keep)
