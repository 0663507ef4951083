"""Words of whole text columns as numpy arrays: where they lie, and a 64-bit hash of each. Used inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at once; texts are never cut by it, only grouped.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def byte_table(separators: bytes) -> np.ndarray:
    """True at each byte that belongs to a word."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Lower-cased text; everything but space and 09-0D.
NOT_BLANK = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Lower-cased text; digits, letters, and all bytes of characters beyond ASCII.
ALPHANUMERIC = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings; null counts as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array without nulls, and its n + 1 offsets into them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], name: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `size` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        _, at = raw(column(batch, name))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = stop
    give_back()


def spans(inside: np.ndarray, at: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes within each text, and the n + 1 offsets of each text's runs. A run also
    ends before each byte of breaks."""
    first, last = inside.copy(), inside.copy()
    apart = ~inside if breaks is None else breaks | ~inside
    first[1:] &= ~inside[:-1] | apart[1:]
    last[:-1] &= apart[1:]
    full = at[1:] > at[:-1]
    begins, finals = at[:-1][full], at[1:][full] - 1
    first[begins], last[finals] = inside[begins], inside[finals]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span, the same wherever the bytes stand. Works through the spans in blocks of bounded bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[b] - total[a]) * down[a]
        i = j
    return mixed(out ^ (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within each text, and the n + 1 offsets of the texts among them. A text of
    fewer words, but not none, is one run."""
    counts = np.diff(at)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    odd = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(size)]
    every = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j, c in enumerate(odd):
        every += words[j:j + len(every)] * c
    starts = np.repeat(at[:-1] - out_at[:-1], runs) + np.arange(out_at[-1])
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = every[np.minimum(starts, max(len(every) - 1, 0))] if len(every) else np.zeros(out_at[-1], np.uint64)
    for k in short:
        own = words[at[k]:at[k + 1]]
        total = np.uint64(len(own))
        for j, c in enumerate(odd[:len(own)]):
            total = np.add(total, np.multiply(own[j:j + 1], c))
        out[out_at[k]] = total[0]
    return mixed(out), out_at
