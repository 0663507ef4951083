"""Packing of tokenised documents into sequences of bounded length: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundweave.llm import shared
from fundweave.llm import words as W
from fundweave.llm.memo import Memo

#: Bytes of text that are tokenised at once. Arrays over them take some 50 times as much, in each worker of an executor.
BLOCK_BYTES = 1 << 18
#: Ranks of one length are counted in so many shares, so that no length is ranked in one task.
SHARES = 64

_SENTINEL = "\x01"
_BLANKS = W.byte_table(b" \t\n\r")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[:0x80] = ~_LETTER[:0x80]
_loaded: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The library's tokenizer, its id of the sentinel, and its memory; kept for the life of the Python worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        (sentinel,) = tokenizer.encode(_SENTINEL, add_special_tokens=False).ids
        _loaded[path] = tokenizer, sentinel, Memo(np.uint32)
    return _loaded[path]


def _ids_of_parts(parts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated ids of the parts. Plain parts are encoded in one call, a sentinel between them."""
    tokenizer, sentinel, _ = _tokenizer(path)
    plain = np.fromiter((_SENTINEL not in part and "<|" not in part for part in parts), bool, len(parts))
    lengths, pieces = np.zeros(len(parts), np.int64), [np.zeros(0, np.uint32)] * len(parts)
    for k in np.flatnonzero(~plain).tolist():
        pieces[k] = np.array(tokenizer.encode(parts[k], add_special_tokens=False).ids, np.uint32)
    own = np.flatnonzero(plain).tolist()
    for i in range(0, len(own), 4096):
        group = own[i:i + 4096]
        text = f" {_SENTINEL} ".join(parts[k] for k in group)
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(ids == sentinel)
        for k, piece in zip(group, np.split(ids, stops), strict=True):
            pieces[k] = piece
        for k in group[1:]:
            pieces[k] = pieces[k][1:]  # the sentinel
    lengths[:] = [len(piece) for piece in pieces]
    return lengths, np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)


def token_ids(data: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text of a block, concatenated, and the n + 1 offsets.

    The vocabulary's rules never join characters over a blank, or over the end of ASCII letters before an ASCII mark or
    digit, or over such a mark (no apostrophe) before a letter. Texts are split there; each different part is encoded
    once. A text with "<|" may hold a special token and stays whole, with its capitals.
    """
    _, _, memo = _tokenizer(path)
    buffer = data.tobytes()
    special, found = np.zeros(len(data), bool), buffer.find(b"<|")
    while found >= 0:
        row = int(np.searchsorted(at, found, "right")) - 1
        special[at[row]:at[row + 1]] = True
        found = buffer.find(b"<|", int(at[row + 1]))
    lower = np.where(special, data, W.LOWER[data]) if special.any() else W.LOWER[data]
    breaks = np.zeros(len(data), bool)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        breaks[1:] = ((_LETTER[a] & _MARK[b]) | (_MARK[a] & (a != 0x27) & _LETTER[b])) & ~special[1:]
    starts, ends, text_at = W.spans(_BLANKS[data] | special, at, breaks)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    keys, first, which = np.unique(W.hashes(lower, starts, ends), return_index=True, return_inverse=True)
    buffer = lower.tobytes()

    def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = first[new]
        return _ids_of_parts([buffer[a:b].decode() for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)], path)

    slots = memo.look_up(keys, encode)[which]
    sizes = memo.at[slots + 1] - memo.at[slots]
    total = np.concatenate([[0], np.cumsum(sizes)])
    flat = memo.pool[np.repeat(memo.at[slots] - total[:-1], sizes) + np.arange(total[-1])]
    return flat, total[text_at]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = 4096, keep_ids: bool = False,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The tokens of each text followed by end_id, cut after every `limit` tokens. One row per piece: doc_id, start,
    length, ids_crc32 (over little-endian unsigned 32-bit ids), doc_tokens, and ids, if kept.

    A null or empty text is the end id alone. Repeated rows give their pieces each. Other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", BLOCK_BYTES):
            data, at = W.raw(W.column(block, "text"))
            flat, ids_at = token_ids(data, at, tokenizer_path)
            n = np.diff(ids_at) + 1
            whole_at = np.concatenate([[0], np.cumsum(n)])
            ids = np.full(whole_at[-1], end_id, "<u4")
            inner = np.ones(len(ids), bool)
            inner[whole_at[1:] - 1] = False
            ids[inner] = flat
            count = -(-n // limit)
            row = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * limit
            length = np.minimum(limit, n[row] - start)
            low = whole_at[row] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
            columns = [block.column(0).take(pa.array(row)), pa.array(start), pa.array(length),
                       pa.array(crc, pa.int64()), pa.array(n[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, whole_at[-1]), pa.int32()), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    found = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return found.mapInArrow(cut, fields + (", ids array<long>" if keep_ids else ""))


def pack_histogram(counts: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns with counts: how often a sequence is made of which (length, times), longest first.

    Lengths are placed longest first, each into the shortest pack, if it fits there, else into a new one. All packs of a
    pattern are treated at once. A step fills a pattern up or ends a length, so at most one pattern more than before is
    left for each length: there are no more than `limit` patterns, whatever the number of documents.
    """
    open_packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # used, tie-break, count, made of
    turn = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_packs and open_packs[0][0] + length <= limit:
                used, _, count, made = heapq.heappop(open_packs)
                taken = min(left, count)
                if count > taken:
                    turn += 1
                    heapq.heappush(open_packs, (used, turn, count - taken, made))
                times = made[-1][1] if made[-1][0] == length else 0
                made = [*made[:-1 if times else None], (length, times + 1)]
            else:
                used, taken, made = 0, left, [(length, 1)]
            turn += 1
            heapq.heappush(open_packs, (used + length, turn, taken, made))
            left -= taken
    return [(count, made) for _, _, count, made in sorted(open_packs)]


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """A row for each length of each pattern: length, first rank, first sequence, times in a sequence, offset there;
    in order of length and rank."""
    rows, next_rank, sequence = [], {}, 0
    for count, made in patterns:
        offset = 0
        for length, times in made:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, times, offset))
            next_rank[length] = rank + times * count
            offset += length * times
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, limit: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table; it is read twice).

    What passes through the driver is the histogram, of at most `limit` lengths, and the patterns' rows: at most `limit`
    patterns of fewer than sqrt(2 * limit) + 1 lengths each. Pieces find their place by the rank within their length.
    Ranks are counted in SHARES shares of each length, so a length that a third of all pieces have isn't one task.
    """
    spark = found.sparkSession
    shared_out = found.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SHARES)))
    counted = shared_out.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[int, int] = {}
    first = np.zeros((limit + 1) * SHARES, np.int64)
    for row in sorted(counted):
        first[row["length"] * SHARES + row["share"]] = counts.get(row["length"], 0)
        counts[row["length"]] = counts.get(row["length"], 0) + row["n"]
    places = _places(pack_histogram(counts, limit))
    known = spark.sparkContext.broadcast((first, places))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, places = known.value
        keys = places[:, 0] * (1 << 45) + places[:, 1]
        for batch in batches:
            length, share, within = (batch.column(k).to_numpy() for k in ("length", "share", "within"))
            rank = first[length * SHARES + share] + within - 1
            _, start, sequence, times, offset = places[np.searchsorted(keys, length * (1 << 45) + rank, "right") - 1].T
            turn = rank - start
            batch = batch.drop_columns(["share", "within"])
            yield batch.append_column("sequence_id", pa.array(sequence + turn // times)).append_column(
                "offset", pa.array(offset + turn % times * length))

    order = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = shared_out.withColumn("within", F.row_number().over(order).cast("long"))
    kind = found.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<long>" if "ids" in found.columns else ""
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{ids}, sequence_id long, offset long"
    return ranked.mapInArrow(place, fields)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = 4096) -> DataFrame:
    """Pieces of all documents with their places. Texts are tokenised once; the small table of pieces is stored."""
    return pack(shared.stored(pieces(docs, tokenizer_path, end_id, limit), "pieces"), limit)
