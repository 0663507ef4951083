"""Bounded samples to fit models on, and sparse bags of features for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(fold: tuple[int, int], id_column: str = "doc_id") -> Column:
    """True for rows no label is learned from: crc32(id as text) mod fold[0] is fold[1], or the id is null."""
    rest = F.crc32(F.col(id_column).cast("string").cast("binary")) % fold[0]
    return F.coalesce(rest == fold[1], F.lit(True))


def sample(labels: DataFrame, label: str, learnable: Column, bound: int, classes: int | None = None,
           kind: str = "int") -> tuple[DataFrame, dict]:
    """(doc_id, label as `kind`) of at most `bound` rows, as many of each class where there are enough but one at least, and
    the number of labelled rows of each class. The rows are those with the smallest hashes of their ids. Where an id
    repeats, its largest label counts; null labels and ids don't. Ids may be of any type, classes any number; of more than
    `classes` classes, if that is given, the most frequent ones."""
    known = labels.select("doc_id", F.col(label).cast(kind).alias("label")).where(learnable & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(F.col("label").isNotNull())
    counts = known.groupBy("label").count().orderBy(F.desc("count"), "label")  # a row for each class
    counts = counts if classes is None else counts.limit(classes)
    totals = {row["label"]: row["count"] for row in counts.collect()}
    known = known if classes is None else known.join(F.broadcast(counts.select("label")), "label", "left_semi")
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    each = max(1, bound // max(1, len(totals)))
    return known.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= each).drop("_place"), totals


class Bags:
    """Sparse rows of weighted features, in both orders, to multiply with matrices of few columns."""

    def __init__(self, rows: list[np.ndarray], weights: list[np.ndarray], width: int) -> None:
        sizes = np.array([len(r) for r in rows])
        self.n, self.width = len(rows), width
        self.column = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
        self.weight = np.concatenate([*weights, np.zeros(0, np.float32)]).astype(np.float32, copy=False)
        self.full_rows, self.row_starts = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
        order = np.argsort(self.column, kind="stable")
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        self.row_weight = self.weight[order]
        self.full_columns, self.column_starts = np.unique(self.column[order], return_index=True)

    @staticmethod
    def _summed(matrix: np.ndarray, index: np.ndarray, weight: np.ndarray, starts: np.ndarray, out: np.ndarray, to: np.ndarray) -> np.ndarray:
        i = 0
        while i < len(starts):  # some groups at once, so that what is gathered stays small
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(starts, lo + (1 << 19))))
            hi = starts[j] if j < len(starts) else len(index)
            part = matrix[index[lo:hi]] * weight[lo:hi, None]
            out[to[i:j]] = np.add.reduceat(part, starts[i:j] - lo, axis=0)
            i = j
        return out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Rows times a (width, k) matrix."""
        out = np.zeros((self.n, matrix.shape[1]), np.float32)
        return self._summed(matrix, self.column, self.weight, self.row_starts, out, self.full_rows)

    def transposed_times(self, matrix: np.ndarray) -> np.ndarray:
        """Columns times an (n, k) matrix."""
        out = np.zeros((self.width, matrix.shape[1]), np.float32)
        return self._summed(matrix, self.row, self.row_weight, self.column_starts, out, self.full_columns)


class Adam:
    """Steps of gradient descent with running means of the gradients and of their squares."""

    def __init__(self, parameters: list[np.ndarray], rate: float) -> None:
        self.parameters, self.rate, self.turn = parameters, rate, 0
        self.mean = [np.zeros_like(p) for p in parameters]
        self.square = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.turn += 1
        for p, g, m, s in zip(self.parameters, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(s / (1 - 0.999**self.turn)) + 1e-8)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values of each text: those from at[i] to at[i + 1]. Texts without values get zeros."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), np.float64)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0, dtype=np.float64)
    return out
