"""Quality scores by a regularised quadratic discriminant.

Statistics of the whole text (length, word length, variety, immediate repeats, classes of characters, lines, sentence
length) are transformed to a bounded skew; each class has its own mean and its own covariance, shrunk towards the
pooled covariance and its diagonal. The score is a logistic function of the difference of the two Mahalanobis
log-densities, which use the cached Cholesky factors.

Null or empty text: scored as a text of no words. Without labelled rows of both classes every score is 0.5. An empty
table gives an empty result; rows with equal ids are scored one by one; other columns are ignored. A document labelled
more than once counts with the mean of its labels, rounded half up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import WordHashes, pick, text_chunks

#: Labelled rows that the discriminant is fitted on, about; the bound of the fit.
SAMPLE = 20_000
#: Shares of the pooled covariance, and of its diagonal, in a class covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
N_FEATURES = 14

# Classes of bytes: other, lower, upper, digit, space, sentence mark, symbol, line end, lead byte of a letter, continuation.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".?;:,"]] = 5
_CLASS[[ord(c) for c in "!\"#$%&'()*+-/<=>@[\\]^_`{|}~"]] = 6
_CLASS[10] = 7
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9


def features(texts: list[bytes], hashes: WordHashes) -> np.ndarray:
    """A row of transformed statistics for each text."""
    n_docs = len(texts)
    words = [t.split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, n_docs)
    flat = np.fromiter((hashes[w] for d in words for w in d), np.uint64, int(n_words.sum()))
    sizes = np.fromiter((len(w) for d in words for w in d), np.float64, len(flat))
    doc = np.repeat(np.arange(n_docs), n_words)
    ends = np.concatenate(([0], np.cumsum(n_words)))

    def per_doc(values: np.ndarray, at: np.ndarray = ends) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[at[1:]] - total[at[:-1]]

    same_doc = doc[1:] == doc[:-1]
    repeat = np.concatenate(([False], (flat[1:] == flat[:-1]) & same_doc)) if len(flat) else np.zeros(0, bool)
    order = np.lexsort((flat, doc))
    sorted_words = flat[order]
    fresh = np.concatenate(([True], (sorted_words[1:] != sorted_words[:-1]) | ~same_doc)) if len(flat) else np.zeros(0, bool)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    classes = _CLASS[buffer]
    lead = np.concatenate(([False], buffer[:-1] == 0xC3)) if len(buffer) else np.zeros(0, bool)
    upper = (classes == 2) | (lead & (buffer < 0x9F) & (buffer >= 0x80))
    byte_ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, n_docs))))
    count = lambda mask: per_doc(mask, byte_ends)
    letters = count((classes == 1) | (classes == 2) | (classes == 8))
    capitals = count(upper)
    symbols, marks, digits, lines = count(classes == 6), count(classes == 5), count(classes == 3), count(classes == 7) + 1
    distinct_lines = np.array([len(set(t.split(b"\n"))) for t in texts], np.float64)
    total = np.maximum(np.diff(byte_ends), 1)
    some = np.maximum(n_words, 1)
    distinct = per_doc(fresh)
    mean_size = per_doc(sizes) / some
    spread = np.sqrt(np.maximum(per_doc(sizes * sizes) / some - mean_size**2, 0))
    share = lambda x: np.log(x + 0.005)
    return np.column_stack([
        np.log1p(n_words),
        np.log(mean_size + 0.5),
        np.log(spread + 0.5),
        distinct / some,
        np.log(distinct + 1) / np.log(some + 2),
        share(per_doc(repeat) / some),
        share(symbols / total),
        share(capitals / np.maximum(letters, 1)),
        share(digits / total),
        share(marks / total),
        np.log1p(n_words / lines),
        share(1 - distinct_lines / lines),
        share(count(buffer == ord("|")) / some),
        letters / total,
    ])


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    #: Inverses of the Cholesky factors, and the logarithms of their determinants.
    whiten: np.ndarray
    log_det: np.ndarray
    #: Of the logistic function of the log-density difference.
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        dens = [-0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - d for m, w, d in zip(self.means, self.whiten, self.log_det)]
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.offset, -40, 40)))


def fit_matrix(x: np.ndarray, y: np.ndarray) -> Model | None:
    if len(y) < 4 or min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - centre) / scale, -8, 8)
    means = np.stack([z[y == c].mean(axis=0) for c in (0, 1)])
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
    whiten, log_det = [], []
    for c in covs:
        c = (1 - TO_POOLED - TO_DIAGONAL) * c + TO_POOLED * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    raw = Model(centre, scale, means, np.stack(whiten), np.array(log_det), 1.0, 0.0)
    d = np.arcsinh(raw.difference(x))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * d).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        hess = np.array([[(w * d * d).sum() + 1e-2, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return Model(centre, scale, means, raw.whiten, raw.log_det, float(max(a, 0.0)), float(b))


def fit(labelled: DataFrame, docs: DataFrame, most: int = SAMPLE) -> Model | None:
    """labelled: (id, label); docs: (id, text). About `most` labelled ids, chosen by a hash of the id, are used."""
    labels = pick(labelled, "id", "label").filter("id is not null and label is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.floor(F.avg("label") + 0.5).cast("int").alias("label"))
    n = labels.count()
    if not n:
        return None
    chosen = labels.filter(F.pmod(F.xxhash64("id", F.lit("quality sample")), F.lit(1 << 20)) < min(1.0, most / n) * (1 << 20))
    rows = pick(docs, "id", "text").join(F.broadcast(chosen), "id")  # bounded by `most`

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            got = [features(texts, hashes) for _, texts in text_chunks(batch, 0, 1)]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(list(np.concatenate(got)), pa.list_(pa.float64()))], ["label", "x"])

    got = rows.select("id", "text", "label").mapInArrow(measure, "label int, x array<double>").toPandas()
    if not len(got):
        return None
    return fit_matrix(np.stack(got["x"].to_numpy()), got["label"].to_numpy())


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs: (id, text). Returns (id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = shared.value, WordHashes()
        for batch in batches:
            got = [model.score(features(texts, hashes)) if model else np.full(len(ids), 0.5) for ids, texts in text_chunks(batch, 0, 1)]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got))], ["id", "score"])

    return pick(docs, "id", "text").select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, score double")
