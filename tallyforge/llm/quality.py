"""Quality of texts by regularised quadratic discriminant analysis.

``statistics`` turns each whole text into ``len(NAMES)`` numbers, transformed so that a class is roughly normal. From
labelled rows only sums leave the executors: for each class a count, a sum and a sum of products. Each class gets
a mean and a covariance that is shrunk towards that of both classes together and towards a multiple of the unit
matrix; its Cholesky factor is kept, and a score is the logistic of the difference of the two log densities plus
the log ratio of the classes' sizes, divided by a temperature that leaves its sign as it is.

Null and empty texts have statistics of zero and are scored like any other. If fewer than two rows of a class are
labelled, every text scores the share of label 1 among the labelled (0.5 without any). Labels other than 0 and 1
are ignored. Every row of ``documents`` that a labelled id has counts, so repeated rows, of documents or of labels, weigh as
often as they stand there; each row gets its own score. A score of exactly 0.5 is accepted. An empty table of documents
gives an empty one. A text of any length is taken whole. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import text as T
from tallyforge.llm.store import Scratch

NAMES = ("words", "word_length", "vocabulary", "top_word", "repeats", "upper", "digits", "points", "shouts", "pipes", "symbols", "foreign", "lines", "ends")
SHRINK_POOLED = 0.1
SHRINK_UNIT = 0.01
TEMPERATURE = 4.0
FEW = 4

_KINDS = 10
_KIND = np.full(256, 8, np.int64)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", range(9, 14), b".,;:'\"-?()", b"!", b"|")):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 9
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    w = T.words(column)
    h, n = w.hashes(), w.counts
    rows = len(n)
    _, offsets = T.utf8(column)
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(rows) * _KINDS, size) + _KIND[w.data], minlength=rows * _KINDS).reshape(rows, _KINDS)
    some, count = np.maximum(size, 1), np.maximum(n, 1)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][n > 0]] = 0
    ended = _END[w.data[w.ends - 1]].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    add = lambda x: np.diff(np.append(0, np.cumsum(x))[w.first])
    distinct, top = np.zeros(rows), np.zeros(rows)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if b > a:
            counts = np.diff(np.flatnonzero(np.concatenate([[True], (s := np.sort(h[a:b]))[1:] != s[:-1], [True]])))
            distinct[i], top[i] = len(counts), counts.max()
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 9], 1)
    out = np.zeros((rows, len(NAMES)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.log1p(size / count)
    out[:, 2] = np.log1p(distinct) / np.log1p(count)
    few, short = count + FEW, some + 5 * FEW  # shares of a few words say little
    shares = (np.maximum(top - 1, 0) / few, add(same) / few, kinds[:, 1] / (letters + 5 * FEW), *(kinds[:, k] / short for k in (2, 5, 6, 7, 8, 9)), kinds[:, 4] / few, add(ended) / few)
    for i, share in enumerate(shares, 3):
        out[:, i] = np.sqrt(share)
    return out


def table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                x = statistics(part.column("text"))
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(T.tidy(run), "doc_id long, x array<double>")


class Discriminant:
    """A fitted model: a few small matrices on the driver, sent with each task."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        """sums: for label 0 and 1 the count, the sum and the sum of products."""
        n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
        self.flat = (n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5) if min(n.values()) < 2 else None
        if self.flat is not None:
            return
        total = n[0] + n[1]
        self.mean = (sums[0][1] + sums[1][1]) / total
        var = np.diag(sums[0][2] + sums[1][2]) / total - self.mean**2
        self.scale = np.sqrt(np.maximum(var, 1e-9))
        centres = {k: (sums[k][1] / n[k] - self.mean) / self.scale for k in n}
        spread = {}
        for k in n:
            second = (sums[k][2] / n[k] - np.outer(self.mean, sums[k][1] / n[k]) - np.outer(sums[k][1] / n[k], self.mean) + np.outer(self.mean, self.mean)) / np.outer(self.scale, self.scale)
            spread[k] = second - np.outer(centres[k], centres[k])
        pooled = sum(n[k] * spread[k] for k in n) / total
        d = len(self.mean)
        self.classes = []
        for k in (0, 1):
            s = (1 - SHRINK_POOLED) * spread[k] + SHRINK_POOLED * pooled
            s = (1 - SHRINK_UNIT) * s + SHRINK_UNIT * max(np.trace(s) / d, 1e-3) * np.eye(d)
            lower = np.linalg.cholesky(s)
            self.classes.append((centres[k], np.linalg.inv(lower), np.log(n[k] / total) - np.log(np.diag(lower)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = (x - self.mean) / self.scale
        log = [c - 0.5 * (((z - centre) @ inverse.T) ** 2).sum(axis=1) for centre, inverse, c in self.classes]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / TEMPERATURE, -700, 700)))


def fit(x: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """From the statistics of all rows that have a label."""
    d = len(NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            own = np.array(batch.column("x").flatten()).reshape(-1, d)
            for k in (0, 1):
                rows = own[label == k]
                held[k] = held.get(k, 0) + np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["label", "place", "value"])

    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    parts = x.join(known, "doc_id").select("label", "x").mapInArrow(T.tidy(run), "label int, place int, value double")
    sums: dict[int, np.ndarray] = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for label, place, value in parts.groupBy("label", "place").agg(F.sum("value")).collect():  # at most 2 (1 + d + d * d) rows
        sums[label][place] = value
    return Discriminant({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in sums.items()})


def _scored(x: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.array(batch.column("x").flatten()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return x.mapInArrow(T.tidy(run), "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are kept for tests."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, from a model of the rows that aren't held out."""
    x = Scratch(docs.sparkSession, "quality").save(table(docs), "statistics")
    return _scored(x, fit(x, labels.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows that the model takes to be of label 1, with all their columns."""
    x = Scratch(docs.sparkSession, "quality").save(table(docs, text_col=text_col), "statistics")
    keep: Callable[[np.ndarray], np.ndarray] = fit(x, labels.where(~held_out())).score

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col):
                yield part.filter(pa.array(keep(statistics(part.column(text_col))) >= 0.5))

    return docs.mapInArrow(T.tidy(run), docs.schema)
