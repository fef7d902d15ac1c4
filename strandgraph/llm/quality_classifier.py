"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

Statistics of bytes, words and word sequences, by logarithms and square roots nearer to normal, make a vector. Each label
has a normal density: mean and covariance of the labelled documents outside the held-out fold, shrunk towards the diagonal
of the pooled covariance. The score is the posterior of label 1: the difference of the log densities (Mahalanobis
distances by the Cholesky factors, made once and sent with the function, and their log determinants) plus the log odds of
the labels, as a logistic. Counts, sums and products are summed in each partition and then by key over all labelled rows;
686 numbers reach the driver whatever the input.

Labels come only from rows whose crc32 of the id's text is not 0 modulo 5; label, language, source and id are no inputs.

Defined results: a null or empty text has the statistics of no words and is scored like others. Null ids match no label and
are not held out. Rows that share an id are scored each by its text, and each counts for a label of the id; repeated labels
count as often as they are there; labels other than 0 and 1 are ignored. If a class has fewer than MIN_ROWS labelled rows
every score is 0.5. Empty tables give empty ones; other columns of either table don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .word_hashes import Chunk, chunks

FOLDS = 5
#: The share of the pooled diagonal in a class's covariance.
SHRINKAGE = 0.2
MIN_ROWS = 20
#: Transformed statistics are cut off at so many pooled standard deviations.
LIMIT = 8.0
PREDICTED_FROM = 0.3

_KINDS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b" \t\n\x0b\x0c\r", b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".", b",;:"), 1):
    _KINDS[list(_chars)] = _k
_KINDS[128:] = 10
N_KINDS = 11
STATISTICS = (
    "words", "word_length", "word_spread", "upper", "capitalised", "symbols", "shouts", "single", "digits", "wide",
    "stops", "commas", "lines", "distinct", "echoes", "triples", "commonest", "others")


def statistics(chunk: Chunk) -> np.ndarray:
    """A row of transformed statistics for each text of the chunk."""
    n = len(chunk.starts) - 1
    of_byte = np.repeat(np.arange(n), np.diff(chunk.offsets))
    kinds = np.bincount(of_byte * N_KINDS + _KINDS[chunk.data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    of, h = chunk.texts(), chunk.hashes[0]
    words = np.diff(chunk.starts).astype(float)
    per = np.maximum(words, 1)
    length = (chunk.ends - chunk.begins).astype(float)
    total = lambda x: np.bincount(of, x, n)
    mean = total(length) / per
    spread = np.sqrt(np.maximum(total(length**2) / per - mean**2, 0))
    first = _KINDS[chunk.data[chunk.begins]] == 3 if len(h) else np.zeros(0, bool)
    echo = np.zeros(len(h))
    echo[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    distinct, commonest = _distinct(of, h, n)
    whole = chunk.whole(3)
    g = chunk.grams(3)[whole] if len(whole) else np.zeros(0, np.uint64)
    triples = np.bincount(of[whole], minlength=n).astype(float)
    fresh, _ = _distinct(of[whole], g, n)
    letters = np.maximum(kinds[:, 3] + kinds[:, 4], 1)
    root = lambda a, b: np.sqrt(a / b)
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), root(kinds[:, 3], letters), total(first) / per,
        np.log1p(kinds[:, 6] / per), root(kinds[:, 7], per), root(total(length == 1), per), root(kinds[:, 5], per),
        root(kinds[:, 10], np.maximum(kinds.sum(axis=1), 1)), root(kinds[:, 8], per), root(kinds[:, 9], per), root(kinds[:, 2], per),
        distinct / per, root(total(echo), per), root(triples - fresh, np.maximum(triples, 1)), root(commonest, per),
        np.log1p(kinds[:, 0] / per),
    ])


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often its commonest one is there."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, of))
    o, v = of[order], h[order]
    edge = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])))
    most = np.zeros(n)
    np.maximum.at(most, o[edge], np.diff(np.append(edge, len(o))).astype(float))
    return np.bincount(o[edge], minlength=n).astype(float), most


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, chunk in chunks(batch.column(1)):
            x = statistics(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(list(x), pa.list_(pa.float64()))], ["key", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        label = batch.column(0).to_numpy()
        for c in (0, 1):
            own = x[label == c]
            sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    for c in (0, 1):
        if sums[c, 0]:
            n = sums.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(sums[c])], ["label", "at", "value"])


class Discriminant:
    """Means and Cholesky factors of two classes; None of either if the labels don't suffice."""

    def __init__(self, sums: np.ndarray, shrinkage: float):
        d = len(STATISTICS)
        n = sums[:, 0]
        self.ready = bool((n >= MIN_ROWS).all())
        if not self.ready:
            return
        means = sums[:, 1 : d + 1] / n[:, None]
        spreads = [sums[c, d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = np.maximum(np.diag(n[0] * spreads[0] + n[1] * spreads[1]) / n.sum(), 1e-9)
        self.centre, self.scale = (n @ means) / n.sum(), np.sqrt(pooled + (n @ (means - (n @ means) / n.sum()) ** 2) / n.sum())
        self.means, self.factors = means, [np.linalg.cholesky((1 - shrinkage) * s + shrinkage * np.diag(pooled)) for s in spreads]
        self.inverses = [np.linalg.inv(f) for f in self.factors]  # of the factors, so that a batch takes products alone
        self.log_determinants = [2 * np.log(np.diag(f)).sum() for f in self.factors]
        self.log_odds = float(np.log(n[1] / n[0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        x = self.centre + np.clip((x - self.centre) / self.scale, -LIMIT, LIMIT) * self.scale
        density = [-(((x - m) @ f.T) ** 2).sum(axis=1) - ld for m, f, ld in zip(self.means, self.inverses, self.log_determinants)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 2 + self.log_odds, -700, 700)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", label_key: str = "doc_id", shrinkage: float = SHRINKAGE) -> Discriminant:
    """The discriminant from all labelled rows of measured (key, x) outside the held-out fold."""
    own = labels.select(labels[label_key].cast("string").alias("of"), labels[label].cast("int").alias("label")).filter("label IN (0, 1)")
    own = own.filter(~held_out(F.col("of")))
    rows = measured.join(own, measured["key"].cast("string") == own["of"]).select("label", "x")
    total = rows.mapInArrow(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for row in total.collect():  # two classes by 343 sums
        sums[row["label"], row["at"]] = row["value"]
    return Discriminant(sums, shrinkage)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, held_out, score, predicted), a row for each of docs."""
    texts = docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(docs, text).alias("the_text"))
    kind = dict(docs.dtypes)[key]
    measured = cut(texts.mapInArrow(_measure, f"key {kind}, x array<double>"))
    model = fit(measured, labels, label, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["key", "score"])

    scored = measured.mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
