"""Language identification: a convolutional network over bytes, applied to fixed-length windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundweave.llm import training
from fundweave.llm import words as W

#: Labelled rows that the network is fitted on, at most, as many of each language as there are.
SAMPLE = 3000
#: Bytes of a window. The last one of a text is filled with zeros.
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBEDDING = 4
#: Windows of a labelled text that are kept for fitting, spread evenly over the whole text.
TRAINING_WINDOWS = 4
_BATCH = 1 << 9


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING; byte 0 stays zero
    kernel: np.ndarray  # (widest * EMBEDDING) x filters; narrower filters have zeros
    kernel_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts of a block, and the n + 1 offsets of the texts among them."""
    count = -(-np.diff(at) // WINDOW)
    out_at = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(out_at[-1] * WINDOW, np.uint8)
    sizes = np.diff(at)
    flat[np.repeat(out_at[:-1] * WINDOW - at[:-1], sizes) + np.arange(at[-1])] = data
    return flat.reshape(-1, WINDOW), out_at


def _patches(windows: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """The embedded bytes under the widest filter at each place, narrower ones seeing the first of them."""
    n, widest = len(windows), max(WIDTHS)
    padded = np.zeros((n, WINDOW + widest - min(WIDTHS)), np.uint8)
    padded[:, :WINDOW] = windows
    embedded = embedding[padded].reshape(n, -1)
    places = np.lib.stride_tricks.sliding_window_view(embedded, widest * EMBEDDING, axis=1)[:, ::EMBEDDING]
    return np.ascontiguousarray(places).reshape(-1, widest * EMBEDDING)


def _kernel_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
    return mask


def _pooled(windows: np.ndarray, net: Network) -> np.ndarray:
    """Highest answer of each filter within each window."""
    answers = (_patches(windows, net.embedding) @ net.kernel).reshape(len(windows), -1, net.kernel.shape[1])
    return np.maximum(answers.max(axis=1) + net.kernel_bias, 0)


def probabilities(windows: np.ndarray, net: Network) -> np.ndarray:
    out = np.zeros((len(windows), len(net.languages)))
    for i in range(0, len(windows), _BATCH):
        out[i:i + _BATCH] = training.softmax(_pooled(windows[i:i + _BATCH], net) @ net.out + net.out_bias)
    return out


def _labelled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in W.blocks(batches, "text"):
        windows, window_at = _windows(*W.raw(W.column(block, "text")))
        rows, kept = [], []
        for k, (low, high) in enumerate(zip(window_at[:-1], window_at[1:], strict=True)):
            for j in np.unique(np.linspace(low, high - 1, min(high - low, TRAINING_WINDOWS)).astype(int)) if high > low else ():
                rows.append(k)
                kept.append(windows[j].tobytes())
        place = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([block.column(0).take(place), block.column(1).take(place), pa.array(kept, pa.binary())],
                                         ["doc_id", "label", "window"])


def fit(docs: DataFrame, fold: tuple[int, int], bound: int = SAMPLE, steps: int = 500, seed: int = 5) -> Network | None:
    """A network from text and lang of at most `bound` rows outside the fold, trained in numpy by Adam on batches drawn
    evenly from the languages, every one of which is learned. Where an id has several, its largest counts. None if no row
    can be learned from."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    learnable = ~training.held_out(fold) & F.col("text").isNotNull()
    picked, totals = training.sample(docs.where(F.col("text").isNotNull()), "lang", learnable, bound, kind="string")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(_labelled_windows, f"doc_id {kind}, label string, window binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("window", "ascending")])
    labels = rows["label"].to_numpy(zero_copy_only=False)
    languages = sorted(set(labels))
    windows = np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    of_language = [np.flatnonzero(labels == name) for name in languages]
    draw = np.random.default_rng(seed)
    mask = _kernel_mask()
    embedding = draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
    embedding[0] = 0
    kernel = (draw.normal(0, 0.3, mask.shape) * mask).astype(np.float32)
    filters = mask.shape[1]
    net = Network(languages, embedding, kernel, np.zeros(filters, np.float32),
                  draw.normal(0, 0.2, (filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    adam = training.Adam([net.embedding, net.kernel, net.kernel_bias, net.out, net.out_bias], 0.01)
    widest = max(WIDTHS)
    for _ in range(steps):
        y = draw.integers(0, len(languages), 64)
        batch = windows[[own[draw.integers(len(own))] for own in (of_language[c] for c in y)]]
        patches = _patches(batch, net.embedding)
        answers = (patches @ net.kernel).reshape(len(batch), -1, filters)
        best = answers.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(answers, best[:, None], 1)[:, 0] + net.kernel_bias, 0)
        wrong = training.softmax(pooled @ net.out + net.out_bias)
        wrong[np.arange(len(y)), y] -= 1
        wrong /= len(y)
        back = (wrong @ net.out.T) * (pooled > 0)
        row = np.repeat(np.arange(len(batch)), filters)
        place, channel, force = best.ravel(), np.tile(np.arange(filters), len(batch)), back.ravel()[:, None]
        seen = patches.reshape(len(batch), -1, widest * EMBEDDING)[row, place]
        g_kernel = np.zeros_like(net.kernel)
        np.add.at(g_kernel.T, channel, seen * force)
        padded = np.zeros((len(batch), WINDOW + widest), np.uint8)
        padded[:, :WINDOW] = batch
        under = padded[row[:, None], place[:, None] + np.arange(widest)]
        g_embedding = np.zeros_like(net.embedding)
        np.add.at(g_embedding, under.ravel(), (net.kernel.T[channel] * force).reshape(-1, EMBEDDING))
        g_embedding[0] = 0
        adam.step([g_embedding, g_kernel * mask, back.sum(axis=0), pooled.T @ wrong, wrong.sum(axis=0)])
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred and score. The answers of all windows of the whole text are averaged by
    their bytes; the language of the highest mean is given, with that mean. `und` with score 0 where the text is null,
    has no letter, or nothing was learned. One pass without a shuffle; other columns are ignored."""
    known = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        for block in W.blocks(batches, "text"):
            data, at = W.raw(W.column(block, "text"))
            windows, window_at = _windows(data, at)
            weight = np.full(len(windows), WINDOW, float)
            full = np.diff(at) > 0
            weight[window_at[1:][full] - 1] = (np.diff(at)[full] - 1) % WINDOW + 1
            letter = block.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if net is None:
                best, mean = np.zeros(len(letter), int), np.zeros((len(letter), 1))
                letter = np.zeros(len(letter), bool)
            else:
                mean = training.text_sums(probabilities(windows, net) * weight[:, None], window_at) / np.maximum(np.diff(at), 1)[:, None]
                best = mean.argmax(axis=1)
            names = np.where(letter, np.array(net.languages if net else ["und"], object)[best], "und")
            score = np.where(letter, np.minimum(mean[np.arange(len(best)), best], 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", "text", letter).mapInArrow(read, f"doc_id {kind}, lang_pred string, score double")
