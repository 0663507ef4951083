"""Toxicity: the mean of subword embeddings of a text goes through a linear softmax; both are trained jointly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundweave.llm import shared, training
from fundweave.llm import words as W

#: Labelled rows that the model is fitted on, at most; as many of each class as there are, up to half. Their texts are of
#: every length; rows are taken, in the order of the sample, as long as their bags have so many buckets together.
SAMPLE, BAG_BUCKETS = 4000, 6_000_000
BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Means are multiplied by it, as a toxic word is about a hundredth of a text.
_SCALE = np.float32(100)
#: So many words without meaning are added to each text, so that one odd word doesn't decide on a text of a few words.
_PADDING = 20


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of 3 to 5 bytes of <word>, and the n + 1 offsets of the words among them."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.empty(at[-1], np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    marked[at[:-1]], marked[at[1:] - 1] = ord("<"), ord(">")
    marked[inner] = data[np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)])[:-1], ends - starts) + np.arange((ends - starts).sum())]
    marked = W.mixed(marked + np.uint64(1))
    found = [W.shingles(marked, at, size) for size in SIZES]
    count = [np.diff(own_at) for _, own_at in found]
    out_at = np.concatenate([[0], np.cumsum(sum(count))])
    out = np.empty(out_at[-1], np.int32)
    shift = np.zeros(len(starts), np.int64)
    for (keys, own_at), n in zip(found, count, strict=True):
        out[np.repeat(out_at[:-1] + shift - own_at[:-1], n) + np.arange(own_at[-1])] = (keys & np.uint64(BUCKETS - 1)).astype(np.int32)
        shift += n
    return out, out_at


def _block(block: pa.RecordBatch) -> tuple:
    """Different words of a block: their subwords; which word stands where; offsets of the texts."""
    data, at = W.raw(W.column(block, "text"))
    data = W.LOWER[data]
    starts, ends, word_at = W.spans(W.ALPHANUMERIC[data], at)
    _, first, which = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
    buckets, bucket_at = _subwords(data, starts[first], ends[first])
    return buckets, bucket_at, which, word_at


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as different buckets with weights: a word weighs the same as any other, and so do its subwords."""
    for block in W.blocks(batches, "text"):
        buckets, bucket_at, which, word_at = _block(block)
        rows, weights = [], []
        for low, high in zip(word_at[:-1], word_at[1:], strict=True):
            own, times = np.unique(which[low:high], return_counts=True)
            sizes = bucket_at[own + 1] - bucket_at[own]
            total = np.cumsum(sizes)
            place = np.repeat(bucket_at[own] - total + sizes, sizes) + np.arange(sizes.sum())
            kept, inverse = np.unique(buckets[place], return_inverse=True)
            rows.append(kept)
            weights.append(np.bincount(inverse, np.repeat(times / np.maximum(sizes, 1) / (high - low + _PADDING), sizes), len(kept)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [block.column(0), block.column(1), pa.array(rows, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))],
            ["doc_id", "label", "buckets", "weights"])


@dataclass
class Model:
    """Embeddings times softmax weights, as the mean commutes with them: two logits for each bucket; and the biases."""

    logits: np.ndarray
    bias: np.ndarray


def _within(bags: DataFrame, buckets: int) -> DataFrame:
    """doc_id and label of the first rows of each class, in the order of the sample, that have an equal share of `buckets`
    together."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = bags.groupBy("doc_id", "label").agg(F.sum(F.size("buckets").cast("long")).alias("n"))  # a few thousand rows
    sizes = sizes.select("doc_id", "label", F.sum("n").over(order).alias("total"), F.row_number().over(order).alias("k"))
    classes = max(1, bags.select("label").distinct().count())
    return sizes.where((F.col("total") <= buckets // classes) | (F.col("k") == 1)).select("doc_id", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], bound: int = SAMPLE, dimension: int = 8,
        rounds: int = 80, seed: int = 7, buckets: int = BAG_BUCKETS, one_in: int = 200) -> Model:
    """A model of `label` (0 or 1) from at most `bound` labelled rows outside the fold, of at most `buckets` buckets in all;
    one row of each class is taken whatever its size. Their texts are turned to bags of buckets by Spark; embeddings and softmax are fitted together in numpy. Both classes weigh the same. Buckets
    that fewer than one in `one_in` of either class's texts have are left out, as they would be learned by heart. Without labelled rows every score is a half;
    with one class it is that class's."""
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    learnable = labels.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    picked, _ = training.sample(learnable, label, ~training.held_out(fold), bound)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
    bags = shared.stored(texts.mapInArrow(_bags, f"doc_id {kind}, label int, buckets array<int>, weights array<float>"), "bags")
    kept = _within(bags, buckets)
    rows = bags.join(F.broadcast(kept), ["doc_id", "label"], "left_semi").toArrow()
    shared.dropped(bags)
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    y = rows["label"].to_numpy().astype(int)[order]
    if not len(y):
        return Model(np.zeros((BUCKETS, 2), np.float32), np.zeros(2, np.float32))
    columns, weights = (list(rows[name].to_numpy()[order]) for name in ("buckets", "weights"))
    seen = np.zeros((2, BUCKETS), np.int32)
    for own, c in zip(columns, y, strict=True):
        seen[c, own] += 1
    used = np.flatnonzero((seen >= np.maximum(1, -(-np.bincount(y, minlength=2) // one_in))[:, None]).any(axis=0))
    new = np.full(BUCKETS, -1, np.int32)
    new[used] = np.arange(len(used))
    for k, own in enumerate(columns):
        kept = new[own] >= 0
        columns[k], weights[k] = new[own[kept]], weights[k][kept] * _SCALE
    bags = training.Bags(columns, weights, len(used))
    del rows, columns, weights
    own = np.bincount(y, minlength=2)
    weight = np.array([1 / max(own[c], 1) for c in (0, 1)])[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    draw = np.random.default_rng(seed)
    embedding = draw.normal(0, 0.1, (len(used), dimension)).astype(np.float32)
    out = draw.normal(0, 0.3, (dimension, 2)).astype(np.float32)
    bias = np.log((own + 0.5) / len(y)).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    adam = training.Adam([embedding, out, bias], 0.05)
    for _ in range(rounds):
        hidden = bags.times(embedding)
        wrong = (training.softmax(hidden @ out + bias) - target) * weight
        adam.step([bags.transposed_times(wrong @ out.T) + np.float32(3e-4) * embedding, hidden.T @ wrong + np.float32(1e-4) * out, wrong.sum(axis=0)])
    logits = np.zeros((BUCKETS, 2), np.float32)
    logits[used] = embedding @ out * _SCALE
    return Model(logits, bias)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: its id and score, the softmax's second class. Whole texts are read, in one pass without
    a shuffle. A null text, or one without words, has the score of the bias. Other columns are ignored."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = known.value.logits, known.value.bias
        for block in W.blocks(batches, "text"):
            buckets, bucket_at, which, word_at = _block(block)
            per_word = training.text_sums(logits[buckets], bucket_at) / np.maximum(np.diff(bucket_at), 1)[:, None]
            mean = training.text_sums(per_word[which], word_at) / (np.diff(word_at) + _PADDING)[:, None]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(training.softmax(mean + bias)[:, 1])], ["id", "score"])

    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return found.mapInArrow(read, f"id {kind}, score double").withColumnRenamed("id", id_column)
