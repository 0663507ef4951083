"""Quality classifier: a factorisation machine over hashed words, statistics of structure, and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundweave.llm import training
from fundweave.llm import words as W

#: Labelled rows that the model is fitted on, at most; as many of each class as there are, up to half.
SAMPLE = 4000
BUCKETS = 1 << 14
STATISTICS = (
    "log bytes", "log words", "capitals", "digits", "marks", "blanks", "line ends", "beyond ASCII", "bars", "full stops",
    "bytes of a word", "words like the one before", "different words", "log n_chars", "n_chars missing")
#: Word shares are multiplied by it, so that they weigh about as much as a statistic.
_SCALE = np.float32(4)


def _class(*ranges: range) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for r in ranges:
        table[r.start:r.stop] = 1
    return table


_SHARES = [
    _class(range(0x41, 0x5B)), _class(range(0x30, 0x3A)),
    _class(range(0x21, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F)), _class(range(0x20, 0x21), range(9, 14)),
    _class(range(10, 11)), _class(range(0x80, 0x100)), _class(range(0x7C, 0x7D)), _class(range(0x2E, 0x2F))]


def _block(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, offsets of the texts among them, and the statistics of each text."""
    data, at = W.raw(W.column(block, "text"))
    lower = W.LOWER[data]
    starts, ends, word_at = W.spans(W.NOT_BLANK[lower], at)
    keys = W.hashes(lower, starts, ends)
    n, sizes = np.diff(word_at), np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    like = np.zeros(len(keys))
    like[1:] = (keys[1:] == keys[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((keys, text))
    new = np.ones(len(keys))
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1])
    per_word, per_byte = 1 / np.maximum(n, 1), 1 / np.maximum(sizes, 1)
    chars = block.column(block.schema.get_field_index("n_chars")).to_numpy(zero_copy_only=False).astype(float)
    missing = ~np.isfinite(chars)
    found = [np.log1p(sizes), np.log1p(n)]
    found += [training.text_sums(table[data], at) * per_byte for table in _SHARES]
    found += [training.text_sums(ends - starts, word_at) * per_word, training.text_sums(like, word_at) * per_word,
              np.bincount(text, new, len(n)) * per_word, np.log1p(np.maximum(np.where(missing, 0, chars), 0)), missing.astype(float)]
    return (keys >> np.uint64(40)).astype(np.int64) % BUCKETS, word_at, np.stack(found, axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as different buckets with counts, and their statistics."""
    for block in W.blocks(batches, "text"):
        buckets, word_at, statistics = _block(block)
        rows, times = zip(*(np.unique(buckets[a:b], return_counts=True) for a, b in zip(word_at[:-1], word_at[1:], strict=True)), strict=True)
        yield pa.RecordBatch.from_arrays(
            [block.column(0), block.column(1), pa.array(rows, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())),
             pa.array(statistics.tolist(), pa.list_(pa.float64()))],
            ["doc_id", "label", "buckets", "times", "statistics"])


@dataclass
class Model:
    """bias; for each bucket, then for each statistic, a weight and a vector; means and deviations of the statistics."""

    bias: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def _standard(statistics: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    return np.clip((statistics - mean) / deviation, -5, 5).astype(np.float32)


def _interactions(summed: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Half of the square of the sum of all x * v, less the squares of each: all pairs in linear time."""
    return 0.5 * ((summed * summed).sum(axis=1) - squares)


def fit(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], bound: int = SAMPLE, rank: int = 4,
        rounds: int = 200, seed: int = 11) -> Model:
    """A factorisation machine for `label` (0 or 1) from at most `bound` labelled rows outside the fold. Each word of a
    text is a feature of value 4 / (number of words), each statistic one of its standard score. Classes are weighted as
    frequent as they are among all labelled rows. Without labelled rows every score is a half."""
    known = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked, totals = training.sample(known, label, ~training.held_out(fold), bound)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = _with_chars(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text", "n_chars")
    schema = f"doc_id {kind}, label int, buckets array<int>, times array<int>, statistics array<double>"
    rows = texts.mapInArrow(_features, schema).toArrow().sort_by("doc_id")
    y = rows["label"].to_numpy().astype(np.float32)
    width = BUCKETS + len(STATISTICS)
    if not len(y):
        zero = np.zeros(width, np.float32)
        return Model(np.zeros(1, np.float32), zero, np.zeros((width, rank), np.float32), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    statistics = np.array(rows["statistics"].to_pylist())
    mean, deviation = statistics.mean(axis=0), statistics.std(axis=0) + 1e-3
    x = _standard(statistics, mean, deviation)
    columns, counts = ([np.asarray(v) for v in rows[name].to_numpy()] for name in ("buckets", "times"))
    size = [max(c.sum(), 1) for c in counts]
    words = training.Bags(columns, [c * _SCALE / n for c, n in zip(counts, size, strict=True)], BUCKETS)
    squared = training.Bags(columns, [c * (_SCALE / n)**2 for c, n in zip(counts, size, strict=True)], BUCKETS)
    own = np.bincount(y.astype(int), minlength=2)
    cost = np.array([totals.get(c, 0) / max(own[c], 1) for c in (0, 1)])[y.astype(int)]
    cost = (cost / cost.sum()).astype(np.float32)
    draw = np.random.default_rng(seed)
    bias = np.zeros(1, np.float32)
    weight = np.zeros(width, np.float32)
    vectors = draw.normal(0, 0.02, (width, rank)).astype(np.float32)
    adam = training.Adam([bias, weight, vectors], 0.03)
    for _ in range(rounds):
        table = np.concatenate([vectors[:BUCKETS], weight[:BUCKETS, None]], axis=1)
        summed = words.times(table)
        q = summed[:, :rank] + x @ vectors[BUCKETS:]
        squares = squared.times((vectors[:BUCKETS]**2).sum(axis=1, keepdims=True))[:, 0] + (x * x) @ (vectors[BUCKETS:]**2).sum(axis=1)
        guess = 1 / (1 + np.exp(-np.clip(bias + summed[:, rank] + x @ weight[BUCKETS:] + _interactions(q, squares), -30, 30)))
        wrong = (guess - y) * cost
        back = words.transposed_times(np.concatenate([q * wrong[:, None], wrong[:, None]], axis=1))
        own_back = squared.transposed_times(wrong[:, None])
        g_vectors = np.concatenate([back[:, :rank] - own_back * vectors[:BUCKETS],
                                    x.T @ (q * wrong[:, None]) - ((x * x).T @ wrong)[:, None] * vectors[BUCKETS:]])
        g_weight = np.concatenate([back[:, rank], x.T @ wrong])
        adam.step([wrong.sum(keepdims=True), g_weight + np.float32(1e-4) * weight, g_vectors + np.float32(1e-4) * vectors])
    return Model(bias, weight, vectors, mean, deviation)


def _score_function(model: Model):
    """Scores of a batch with text and n_chars."""
    vectors = model.vectors[:BUCKETS]
    table = np.concatenate([vectors, model.weight[:BUCKETS, None], (vectors**2).sum(axis=1, keepdims=True)], axis=1)
    rank = vectors.shape[1]

    def scores(block: pa.RecordBatch) -> np.ndarray:
        buckets, word_at, statistics = _block(block)
        x = _standard(statistics, model.mean, model.deviation)
        unit = (_SCALE / np.maximum(np.diff(word_at), 1))[:, None]
        summed = training.text_sums(table[buckets], word_at)
        q = summed[:, :rank] * unit + x @ model.vectors[BUCKETS:]
        squares = summed[:, rank + 1] * unit[:, 0]**2 + (x * x) @ (model.vectors[BUCKETS:]**2).sum(axis=1)
        logit = model.bias + summed[:, rank] * unit[:, 0] + x @ model.weight[BUCKETS:] + _interactions(q, squares)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    return scores


def _with_chars(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars; the last null where there is none."""
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", chars.cast("double").alias("n_chars"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id and score, the probability of label 1. Whole texts are read, in one pass without a
    shuffle. A null text is an empty one, a null n_chars a feature of its own. Columns other than doc_id, text and
    n_chars are ignored."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _score_function(known.value)
        for block in W.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(scores(block))], ["doc_id", "score"])

    return _with_chars(docs).mapInArrow(read, f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Rows of docs, with their columns, that score `threshold` or more; null texts, null n_chars and repeated rows as in
    score. Rows go through Arrow in slices of bounded bytes and are never Python objects; nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _score_function(known.value)
        for block in W.blocks(batches, "text"):
            *own, counted = block.columns
            text = block.column(block.schema.get_field_index("text"))
            found = scores(pa.RecordBatch.from_arrays([text, counted], ["text", "n_chars"]))
            yield pa.RecordBatch.from_arrays(own, block.schema.names[:-1]).filter(pa.array(found >= threshold))

    return docs.withColumn("_counted_chars", chars.cast("double")).mapInArrow(read, docs.schema)
