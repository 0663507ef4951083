"""Text to vectors: a hashed word-count default and a hook for an embedding model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from fundweave import fixed_values as fv

Embedder = Callable[[Column], Column]

# Words are what remains between ASCII characters that are neither letter nor digit.
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_CACHED_WORDS = 500_000
#: Characters and number of texts whose words are found at once, and the share of different words up to which that pays.
_GROUP_CHARS, _GROUP_TEXTS, _FEW_WORDS = 512 * 1024, 1024, 1 / 8


class _Buckets(dict):
    """Bucket of each word met so far in a Python worker."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        digest = hashlib.md5(word).hexdigest()
        bucket = self[word] = int(digest[:7], 16) % self.dim
        return bucket


def _blanked(text: str) -> bytes:
    return text.lower().encode().translate(_BLANKED)


def _counted(text: str, buckets: _Buckets) -> np.ndarray:
    """Word counts of one text, word by word."""
    words = _blanked(text).split()
    found = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    return np.bincount(found, minlength=buckets.dim).astype("float32")


def _counted_together(texts: list[str], buckets: _Buckets) -> tuple[np.ndarray, float]:
    """The same, a row for each text, and the share of different words. Words are found and told apart as bytes of one array;
    only different ones become objects."""
    blanked = [_blanked(text) for text in texts]
    joined = np.frombuffer(b"".join(piece for text in blanked for piece in (b" ", text)) + b" ", np.uint8)
    solid = joined != 32
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1  # where words begin and end, in turn
    begins, ends = edges[::2], edges[1::2]
    offsets = np.append(0, np.cumsum(ends - begins)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined[solid])]).dictionary_encode()
    places = np.fromiter(map(buckets.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
    bounds = np.append(0, np.cumsum([len(text) + 1 for text in blanked]))
    rows = np.repeat(np.arange(len(texts)) * buckets.dim, np.diff(np.searchsorted(begins, bounds)))
    found = np.bincount(rows + places[words.indices.to_numpy()], minlength=len(texts) * buckets.dim)
    return found.astype("float32").reshape(len(texts), buckets.dim), len(places) / max(1, len(begins))


def _groups(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """The texts that are there, some at a time: what is made of their words is several times as long."""
    group, chars = [], 0
    for text in texts:
        if text is not None:
            group.append(text)
            chars += len(text)
        if chars >= _GROUP_CHARS or len(group) >= _GROUP_TEXTS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _all_counted(texts: Iterator[str | None], buckets: _Buckets) -> list[np.ndarray]:
    """Word counts of the texts that are there, in either way as their words repeat themselves or not."""
    out, share = [], 0.0
    for k, group in enumerate(_groups(texts)):
        if share <= _FEW_WORDS or k % 16 == 0:
            counts, share = _counted_together(group, buckets)
            out.append(counts)
        else:
            out += [_counted(text, buckets) for text in group]
    return out


def _listed(vectors: list[np.ndarray], missing: np.ndarray, dim: int) -> pa.Array:
    """The vectors of ``dim`` numbers of those that are not missing as a list array; the others are null."""
    ends = np.append(0, np.cumsum(~missing)) * dim
    flat = np.concatenate([np.zeros(0, np.float32), *(rows.ravel() for rows in vectors)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(missing))


def hashed_counts(dim: int = fv.VECTOR_DIM) -> Embedder:
    """Word counts in ``dim`` buckets: first seven hex digits of the word's md5, modulo ``dim``.

    Counts are whole numbers, so dot products of two such vectors are exact.
    Spark is told not to move or repeat the call, as if it were not deterministic. Vectors leave a task as an Arrow array:
    of a series of arrays Spark makes lists of number objects, which takes longer than the counting. Called on series,
    outside Spark, the function gives series.
    """

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets(dim)
        for texts in batches:
            if isinstance(texts, pd.Series):
                known = texts.notna().to_numpy()
                yield pd.Series([_counted(text, buckets) if is_text else None for text, is_text in zip(texts, known)], dtype=object)
            else:
                missing = texts.is_null().to_numpy(zero_copy_only=False)
                yield _listed(_all_counted((text.as_py() for text in texts), buckets), missing, dim)

    return embed.asNondeterministic()


def model_hook(load: Callable[[], Any], batch: int = fv.EMBED_BATCH) -> Embedder:
    """Embed with ``load().encode(list_of_texts)``; each Python worker calls ``load`` once."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows: list = []
            for start in range(0, len(texts), batch):
                part = texts.iloc[start:start + batch]
                found = iter(model.encode(part.dropna().tolist()))
                rows.extend(None if text is None else np.asarray(next(found), "float32") for text in part)
            yield pd.Series(rows)

    return embed.asNondeterministic()


def wrong_length(embedding: Column, dim: int) -> Column:
    return embedding.isNull() | (F.size(embedding) != F.lit(dim))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in one row; null if one of them is all zeros."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
