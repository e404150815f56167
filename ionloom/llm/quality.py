"""Quality scores from a regularised quadratic discriminant over document statistics.

Each class, label 1 and label 0, has a mean and a covariance of the transformed statistics; the covariance is
shrunk towards its own diagonal and the diagonal towards that of both classes. Their Cholesky factors are kept,
and a score is the logistic of half the difference of the two Mahalanobis distances and log determinants, plus
the log odds of the labels.

The sums behind means and covariances come from all labelled documents outside the held-out fold, as one
aggregate; the driver gets two means and two matrices. Every text is measured whole.

Null and empty texts have the statistics of an empty text. Labels that are neither 0 nor 1, and labels without
a document, are not used; without labels of both kinds every score is the share of label 1, or a half without
any. Repeated rows score alike. An empty table gives no rows; columns other than doc_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import documents, text_or_empty, written
from ionloom.llm.labelled import held_out, training_labels

#: How far a class covariance is drawn to its diagonal, and its diagonal to the pooled one.
SHRINK, POOL = 0.2, 0.1
#: A log-density difference is divided by this before the logistic, which keeps scores from 0 and 1.
SOFTEN = 4.0
PRIOR_WORDS, PRIOR_BYTES = 30, 150

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_WHITE = np.array([9, 10, 11, 12, 13, 32])
_STOPS = np.frombuffer(b".,;:?!", np.uint8).astype(int)
_SIGNS = np.frombuffer(b"#$%&*+<=>@\\^_`{}~/", np.uint8).astype(int)
STATISTICS = [
    "log words", "word length", "upper share", "digit share", "stop share", "sign share", "bar share", "exclamation share",
    "other bytes", "distinct words", "top word", "repeated neighbours", "line length", "distinct lines", "capital words",
]


def _logit(share: float) -> float:
    """Shares on a scale on which they spread, with room at both ends."""
    share = 0.001 + 0.998 * min(1.0, max(0.0, share))
    return float(np.log(share / (1 - share)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS.

    Shares are drawn to those of usual prose by PRIOR_WORDS words and PRIOR_BYTES bytes, so that a text of a
    few words is not odd for what few words must look like.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, size = len(words), len(raw) - int(bins[_WHITE].sum())
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    w, b = n + PRIOR_WORDS, size + PRIOR_BYTES

    def of_bytes(count: int, usual: float) -> float:
        return _logit((count + usual * PRIOR_BYTES) / b)

    return [
        float(np.log(w)), float(np.log(b / w)), of_bytes(bins[_UPPER].sum(), 0.02), of_bytes(bins[_DIGITS].sum(), 0.001),
        of_bytes(bins[_STOPS].sum(), 0.02), of_bytes(bins[_SIGNS].sum(), 0.0), of_bytes(bins[124], 0.0), of_bytes(bins[33], 0.0),
        of_bytes(bins[128:].sum(), 0.05), _logit((len(counts) + PRIOR_WORDS) / w) * float(np.sqrt(np.log(w)) / 2), _logit(max(counts.values(), default=0) / w),
        _logit(again / w), float(np.log((n + PRIOR_WORDS) / (len(lines) + 1))), _logit((len(set(lines)) + 5) / (len(lines) + 5)),
        _logit((sum(x[:1].isupper() for x in words) + 0.1 * PRIOR_WORDS) / w),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, x): the statistics of each row of `docs`; row_key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "row_key", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id long, row_key long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log odds."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    odds: float

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
        """From the count, the sums and the sums of products of each class, label 0 first."""
        d = sums.shape[1]
        odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
        if n.min() < 2:
            flat = np.stack([np.eye(d)] * 2)
            return cls(np.zeros((2, d)), flat, np.zeros(2), 0.0 if n.sum() == 0 else odds)
        means = sums / n[:, None]
        covariances = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
        within = np.tensordot(n / n.sum(), covariances, 1)
        pooled = np.maximum(np.diag(within), 1e-3)
        factors, logdets = [], []
        for own in covariances:
            diagonal = (1 - POOL) * np.diag(own) + POOL * pooled
            shrunk = (1 - SHRINK) * own
            np.fill_diagonal(shrunk, diagonal)
            lower = np.linalg.cholesky(shrunk)
            factors.append(np.linalg.inv(lower))
            logdets.append(2 * np.log(np.diag(lower)).sum())
        return cls(means, np.stack(factors), np.array(logdets), odds)

    def score(self, x: np.ndarray) -> np.ndarray:
        whitened = np.einsum("cij,ncj->nci", self.factors, x[:, None, :] - self.means[None])
        density = -0.5 * (whitened**2).sum(2) - 0.5 * self.logdets
        margin = (density[:, 1] - density[:, 0] + self.odds) / SOFTEN
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_on(measures: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of all rows of `measures` with a label; sums are made in the tasks and then added up."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x, y = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy()
                for label in (0, 1):
                    own = x[y == label]
                    total[label] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        places = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.ravel())], ["place", "value"])

    labelled = measures.join(labels.hint("shuffle_hash"), "doc_id").select("x", "label")
    parts = labelled.mapInArrow(run, "place int, value double")
    sums = np.zeros(2 * (1 + d + d * d))
    for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[row["place"]] = row["value"]
    sums = sums.reshape(2, -1)
    return Discriminant.fit(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def scored(measures: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, row_key, score, predicted)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "row_key", "score", "predicted"])

    return measures.select("doc_id", "row_key", "x").mapInArrow(run, "doc_id long, row_key long, score double, predicted int")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that the classifier rejects, columns as given; the pipeline's stage."""
    model = fit_on(written(measured(docs), "statistics"), labels)
    return _accepted(docs, model)


def _accepted(docs: DataFrame, model: Discriminant) -> DataFrame:
    fields = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array([statistics(t.as_py()) for t in batch.column(at)]))
                yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, fields)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = written(measured(documents(spark, sf_dir)), "statistics")
    model = fit_on(measures, training_labels(spark, sf_dir, "quality", 3, 1))
    out = scored(measures, model)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
