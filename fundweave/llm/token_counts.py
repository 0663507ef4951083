"""Token counts of whole texts, by batches in Arrow tasks that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundweave.llm import words as W
from fundweave.llm.memo import Memo

_loaded: dict[str, tuple] = {}


def _processor(path: str) -> tuple:
    """The library's processor and its memory of counts; both are kept for the life of the Python worker."""
    if path not in _loaded:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (processor.id_to_piece(i).lstrip("▁") for i in range(processor.get_piece_size()))
        if any("▁" in piece for piece in pieces):
            raise ValueError("a piece of this vocabulary spans a space; texts can't be split at spaces")
        _loaded[path] = processor, Memo(np.int32)
    return _loaded[path]


def safe_boundaries(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True at each space where a text can be split, the space being dropped, without changing its tokens: single spaces
    between bytes that can't be part of a run of spaces, written as such or as the mark that stands for one."""
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        before, after = data[:-2], data[2:]
        cut[1:-1] = (data[1:-1] == 0x20) & (before != 0x20) & (before != 0x81) & (after != 0x20) & (after != 0xE2)
        full = at[1:] > at[:-1]
        cut[at[:-1][full]] = False
        cut[at[1:][full] - 1] = False
    return cut


def _counts(data: np.ndarray, at: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text of a block."""
    processor, memo = _processor(path)
    starts, ends, text_at = W.spans(~safe_boundaries(data, at), at)
    if not len(starts):
        return np.zeros(len(at) - 1, np.int64)
    keys, first, which = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
    buffer = data.tobytes()

    def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = first[new]
        parts = [buffer[a:b].decode() for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
        lengths = np.fromiter(map(len, processor.encode(parts, num_threads=1)), np.int32, len(parts))
        return np.ones(len(parts), np.int64), lengths

    slots = memo.look_up(keys, encode)
    total = np.concatenate([[0], np.cumsum(memo.pool[memo.at[slots]].astype(np.int64)[which])])
    return total[text_at[1:]] - total[text_at[:-1]]


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_bytes (UTF-8) and n_tokens by the sentencepiece model at `model_path`, a file
    that every executor has (it belongs to an installed package).

    Texts are grouped to blocks of about equal bytes. Each text is split at every safe boundary, so that a long text is
    never one call, and each different part of a block is encoded once, in one batch. A null text counts as empty: 0
    tokens. Repeated rows are counted each; null ids stay null; other columns are ignored. No shuffle.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text"):
            data, at = W.raw(W.column(block, "text"))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(np.diff(at)), pa.array(_counts(data, at, model_path))],
                ["id", "n_bytes", "n_tokens"])

    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = found.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return found.withColumnRenamed("id", id_column)


def over_limit(counted: DataFrame, limit: int) -> DataFrame:
    """Adds over_limit: more than `limit` tokens."""
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
