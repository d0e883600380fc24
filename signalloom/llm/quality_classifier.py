"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Statistics are some twenty numbers of the whole text (lengths, shares of character classes, repetition by word, window and
line). Standardised, they are mapped to cosines of random projections, whose inner products approximate a Gaussian kernel;
the normal equations of ridge regression on them are summed over partitions and solved on the driver. The raw ridge value is
turned into a probability by isotonic regression on a histogram of the training rows' values.

Labels are read from the rows whose fold is not 0 and serve for nothing else; lang, source and doc_id are no inputs. The model
is fitted to at most about TRAINING_ROWS of them, chosen by hash of the id.

Cases: very long texts are measured whole; rows of equal statistics get equal scores, so ties decide nothing; null and empty texts have all-zero statistics and get a score like any other; without labelled rows, or with labels
of one kind only, every score is that share (one half if there is none); repeated rows get equal scores; a doc_id with more
than one label takes the smallest; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import bounded_batches, fold, free_names, materialise, text_bytes, text_rows
from signalloom.llm.linear import matrix, partition_sums
from signalloom.llm.quality_rules import BYTE_CLASS, CLASSES, SYMBOL_BYTES, byte_histogram, repeated_words

FOLDS = 5
THRESHOLD = 0.3
FEATURES = 256
BANDWIDTH = 3.0
RIDGE = 1e-3
SEED = 11
BINS = 400
#: Labelled rows of the training folds that the model is fitted to, about, at most.
TRAINING_ROWS = 500_000
STATISTICS = (
    "log_words", "word_length", "word_spread", "unique_share", "top_word_share", "echo_share", "window_share", "dup_line_share", "log_line", "single_share",
    "symbols_per_word", "marks_per_word", "upper_heavy_share", "symbol_word_share", *CLASSES,
)


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = byte_histogram(text)
    classes = seen @ BYTE_CLASS
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    echo = sum(map(bytes.__eq__, words, words[1:]))
    shouted = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    marked = sum(c for w, c in counts.items() if not w.translate(None, b"#*$%&|<>!") or w[-1:] in b"#*$%&|<>!")
    log_n = np.log1p(n)
    return [
        float(log_n), float(lengths.mean()), float(lengths.std()), len(counts) / n, max(counts.values()) / n, echo / n, repeated_words(words) / n,
        1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(len(text) / max(len(lines), 1))), float((lengths == 1).mean()),
        float(seen[SYMBOL_BYTES].sum()) / n, float(classes[CLASSES.index("mark")]) / n, shouted / n, marked / n, *(classes / max(classes.sum(), 1)).tolist(),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])


def document_statistics(docs: DataFrame) -> DataFrame:
    rows = text_rows(docs)
    return rows.mapInArrow(_statistics, "doc_id long, features array<double>")


class Model:
    """Standardisation, projection, ridge weights and the calibration steps; a few hundred kilobytes at any input size."""

    def __init__(self, features: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.d = len(STATISTICS)
        self.project = rng.normal(size=(self.d, features)) / bandwidth
        self.phase = rng.uniform(0, 2 * np.pi, size=features)
        self.mean, self.scale = np.zeros(self.d), np.ones(self.d)
        self.weights: np.ndarray | None = None
        self.constant, self.edges, self.values = 0.5, np.zeros(0), np.zeros(0)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def design(self, x: np.ndarray) -> np.ndarray:
        s = self.standard(x)
        z = np.sqrt(2 / self.project.shape[1]) * np.cos(s @ self.project + self.phase)
        return np.hstack([np.ones((len(x), 1)), s, z])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def isotonic(at: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order: the bins' mean places and their non-decreasing shares."""
    blocks: list[list[float]] = []  # sum of places, positives, total
    for x, p, n in zip(at, positives, totals, strict=True):
        blocks.append([x * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.asarray([b[0] / b[2] for b in blocks]), np.asarray([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, **options) -> Model:
    """Fit on (features, label) rows."""
    model = Model(**options)
    d = model.d

    def moments(batch):
        x = matrix(batch.column(0), d)
        y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)])

    sums = partition_sums(rows, moments, 2 + 2 * d)
    n, positives = sums[:2]
    if n:
        model.constant = float(positives / n)
    if not 0 < positives < n:
        return model
    model.mean = sums[2 : 2 + d] / n
    spread = np.sqrt(np.maximum(sums[2 + d :] / n - model.mean**2, 0))
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    width = 1 + d + model.project.shape[1]

    def normal(batch):
        z = model.design(matrix(batch.column(0), d))
        y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = partition_sums(rows, normal, width * width + width)
    gram = sums[: width * width].reshape(width, width)
    penalty = np.full(width, RIDGE * n)
    penalty[0] = 1e-9 * n
    model.weights = np.linalg.solve(gram + np.diag(penalty), sums[width * width :])

    def histogram(batch):
        raw = model.raw(matrix(batch.column(0), d))
        y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)
        bins = np.clip(((raw + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(bins, minlength=BINS), np.bincount(bins, y, minlength=BINS)])

    sums = partition_sums(rows, histogram, 2 * BINS)
    full = np.flatnonzero(sums[:BINS])
    model.edges, model.values = isotonic((full + 0.5) * 2 / BINS - 0.5, sums[BINS:][full], sums[:BINS][full])
    return model


def training_labels(labels: DataFrame, column: str, folds: int = FOLDS, rows: int = TRAINING_ROWS) -> DataFrame:
    """(__doc, label) of the ids whose fold is not 0 and whose label is known: all of them, or beyond `rows` about so many,
    chosen by a hash of the id. Small enough to broadcast whatever the input."""
    known = labels.filter(F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.min(column).cast("double").alias("label"))
    known = materialise(known.filter(fold(F.col("__doc"), folds) != 0), "training_labels")
    part = int(1_000_000 * min(1.0, rows / max(known.count(), 1)))
    return known.filter(F.pmod(F.xxhash64("__doc"), F.lit(1_000_000)) < part)


def labelled(statistics_rows: DataFrame, known: DataFrame) -> DataFrame:
    """(features, label) of the rows with a training label."""
    return statistics_rows.join(F.broadcast(known), F.col("doc_id") == F.col("__doc")).select("features", "label")


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1), model.d)))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = materialise(document_statistics(docs), "statistics")
    train = materialise(labelled(rows, training_labels(labels, "quality")), "labelled")
    scored = rows.mapInArrow(_score(fit(train, **options)), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns. Texts are scored where they lie, without a shuffle."""
    bounded_batches(docs.sparkSession)
    known = training_labels(labels, "quality")
    # only texts with a training label are looked at for the fit; their ids are a bounded broadcast, so no text is shuffled
    (doc,) = free_names(docs, "__doc")
    ids = F.broadcast(known.select(F.col("__doc").alias(doc)))
    own = docs.join(ids, F.col("doc_id").cast("long") == F.col(doc), "left_semi")
    train = materialise(labelled(document_statistics(own), known), "labelled")
    model = fit(train, **options)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray([statistics(t) for t in text_bytes(batch.column(batch.schema.get_field_index("text")))]).reshape(-1, model.d)
            yield batch.filter(pa.array(model.score(rows) >= threshold))

    return docs.mapInArrow(accepted, docs.schema)
