"""Words and their spelling variants: tiles of words that agree in a prefix and a suffix are compared as padded matrices of
code points; where common prefix and common suffix together reach the longer length minus one, one edit lies between."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundweave.llm import shared
from fundweave.llm import words as W

#: Parts of a word; a tile holds words that agree in all parts but one. Words of a block of a crowded tile.
PARTS, BLOCK_WORDS = 4, 1024
_CELLS = 1 << 22
#: Bytes of text whose words are counted at once.
_TEXT_BYTES = 1 << 22

# The letters are A-Z, a-z and U+00C0 to U+00FF, in UTF-8 C3 80 to C3 BF.
_LEAD = 0xC3


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True at each byte of a letter."""
    lower = W.LOWER[data]
    inside = ((lower >= 0x61) & (lower <= 0x7A)) | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    return inside


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc_after(seeds: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each byte span, continued from the crc32 of what stands before it."""
    crc, sizes = ~seeds.astype(np.uint32), ends - starts
    order = np.argsort(-sizes, kind="stable")
    crc, starts, sizes = crc[order], starts[order], sizes[order]
    left, step = len(order), 0
    while left:
        left = int(np.searchsorted(-sizes, -step, "left"))  # spans of more than `step` bytes
        crc[:left] = _CRC[(crc[:left] ^ data[starts[:left] + step]) & 0xFF] ^ (crc[:left] >> 8)
        step += 1
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _dropped(word: bytes, h: int) -> bytes:
    text = word.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1:]).encode()


def _count(batch: pa.RecordBatch, shortest: int, one_in: int) -> tuple[list[bytes], np.ndarray]:
    """Different words of the batch's texts and how often each occurs."""
    data, at = W.raw(W.column(batch, "text"))
    starts, ends, text_at = W.spans(_letters(data, at), at)
    data = W.LOWER[data]
    leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
    points = ends - starts - (leads[ends] - leads[starts])
    text = np.repeat(np.arange(len(at) - 1), np.diff(text_at))
    long_enough = points >= shortest
    starts, ends, points, text = starts[long_enough], ends[long_enough], points[long_enough], text[long_enough]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    ids = batch.column(0).cast(pa.string()).to_pylist()
    known = np.array([x is not None for x in ids])
    seeds = np.array([zlib.crc32(f"{x}:".encode()) if x is not None else 0 for x in ids], np.uint32)
    h = crc_after(seeds[text], data, starts, ends)
    less = (h % one_in == 0) & known[text]
    keys, first, times = np.unique(W.hashes(data, starts[~less], ends[~less]), return_index=True, return_counts=True)
    buffer = data.tobytes()
    whole = [buffer[a:b] for a, b in zip(starts[~less][first].tolist(), ends[~less][first].tolist(), strict=True)]
    cut = [_dropped(buffer[a:b], x) for a, b, x, n in zip(*(v[less].tolist() for v in (starts, ends, h, points)), strict=True) if n > shortest]
    return [*whole, *cut], np.concatenate([times, np.ones(len(cut), np.int64)])


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2, one_in: int = 31) -> DataFrame:
    """word and n of the words of at least `shortest` code points that occur `least` times or more in all texts of docs
    (doc_id, text). A word is a maximal run of letters with A-Z in lower case; where one_in divides the crc32 of
    `doc_id:run`, the run loses its code point at that number modulo its length. A null text has no words; without a doc_id
    no run loses a letter; a row that repeats counts again."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", _TEXT_BYTES):
            words, times = _count(block, shortest, one_in)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times)], ["word", "n"])

    partial = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _tile(kind: Column, size: Column, part: int, parts: int) -> Column:
    """The hash of a word without one part, for pairs whose longer word has `size` code points."""
    low = F.floor(size * part / parts).cast("int")
    after = size - F.floor(size * (part + 1) / parts).cast("int")
    head = F.substring("word", F.lit(1), low)
    tail = F.substring("word", F.char_length("word") - after + 1, after)
    return F.xxhash64(kind, size, head, tail)


def _tiles(words: DataFrame, parts: int) -> DataFrame:
    """word, n, size, part, tile: every word in the tiles of pairs in which it is as long as the other or longer, and of
    those in which it is one code point shorter."""
    own = words.withColumn("size", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("part"), _tile(F.lit(k), F.col("size"), k, parts).alias("tile")) for k in range(parts)))
    return own.select("word", "n", "size", F.explode(each).alias("t")).select("word", "n", "size", "t.part", "t.tile")


def _matrices(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points from the left and from the right, padded to one more than the longest word."""
    width = int(sizes.max()) + 1
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.uint8 if not len(points) or points.max() < 256 else np.uint32
    left = np.zeros((len(words), width), kind)
    right = np.zeros((len(words), width), kind)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left[row, place] = points
    right[row, sizes[row] - 1 - place] = points
    return left, right


def one_edit(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs (a, b) of rows, the place of the only edit, in the longer word; -1 if there are more, or none."""
    longer, shorter = np.maximum(sizes[a], sizes[b]), np.minimum(sizes[a], sizes[b])
    differs = left[a] != left[b]
    prefix = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), longer), shorter)
    differs = right[a] != right[b]
    suffix = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), longer), shorter)
    near = (prefix + suffix >= longer - 1) & (prefix < longer)
    return np.where(near, prefix, -1)


def _pairs(tile: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same tile, tiles being runs, in blocks of about `most` pairs."""
    n = len(tile)
    stop = np.searchsorted(tile, tile, "right") if n else np.zeros(0, int)
    counts = stop - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(counts)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        a = np.repeat(np.arange(i, j), counts[i:j])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], counts[i:j])
        i = j


def _compare(parts: int):
    """Reads rows sorted by size and tile; gives the pairs of near words, each from the one tile of its edit's part."""

    def near(rows: pa.Table) -> pa.RecordBatch | None:
        size = rows["size"][0].as_py()
        words, own = rows["word"].to_pylist(), pc.utf8_length(rows["word"]).to_numpy().astype(np.int64)
        part, shard = rows["part"].to_numpy(), rows["shard"].to_numpy()
        cross = rows["i"].to_numpy() != rows["j"].to_numpy()
        places = [rows[name].to_numpy() for name in ("tile", "part", "i", "j")]
        change = np.any([p[1:] != p[:-1] for p in places], axis=0)
        tile = np.concatenate([[0], np.cumsum(change)])
        left, right = _matrices(words, own)
        found = []
        for a, b in _pairs(tile, max(1, _CELLS // (size + 1))):
            fits = ((own[a] == size) | (own[b] == size)) & (~cross[a] | (shard[a] != shard[b]))
            a, b = a[fits], b[fits]
            edit = one_edit(left, right, own, a, b)
            ok = edit >= 0
            a, b, edit = a[ok], b[ok], edit[ok]
            mine = (edit >= size * part[a] // parts) & (edit < size * (part[a] + 1) // parts)
            found.append(np.stack([a[mine], b[mine]]))
        if not found:
            return None
        a, b = np.concatenate(found, axis=1)
        n = rows["n"].combine_chunks()
        word = rows["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], ["word", "n", "other", "other_n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None

        def closed() -> Iterator[pa.RecordBatch]:
            if kept:
                made = near(pa.Table.from_batches(kept))
                if made is not None and made.num_rows:
                    yield made
                kept.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = np.stack([batch.column(batch.schema.get_field_index(name)).to_numpy() for name in ("size", "tile", "part", "i", "j")])
            before = tiles[:, :1] if last is None else last
            new = np.diff(np.concatenate([before, tiles], axis=1), axis=1) != 0
            last = tiles[:, -1:]
            edges, sizes = np.flatnonzero(new.any(axis=0)), np.flatnonzero(new[0])
            at = 0
            while at < batch.num_rows:  # cut where the size changes, and at the first edge after enough rows
                held = sum(part.num_rows for part in kept)
                least = at if held else at + 1
                enough = max(least, at - held + _CELLS // 64 // (int(tiles[0, at]) + 1))
                cuts = [e[k] for e, low in ((sizes, least), (edges, enough)) if (k := np.searchsorted(e, low)) < len(e)]
                cut = int(min(cuts, default=batch.num_rows))
                if cut > at:
                    kept.append(batch.slice(at, cut - at))
                at = cut
                if cuts:
                    yield from closed()
        yield from closed()

    return read


def near_pairs(words: DataFrame, parts: int = PARTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n, other, other_n: every pair of words (word, n; each word once) that differ by exactly one inserted, deleted or
    replaced code point, once, in either order.

    One edit leaves all but one of the `parts` parts of the longer word as they are. So a word lies in a tile for each part:
    the words with the same prefix before and the same suffix after it. Tiles of more than `block_words` words are divided
    into blocks, and every pair of blocks is a group of its own, so no group grows with the data. A pair that several tiles
    hold comes from the one that holds its edit.
    """
    tiled = _tiles(words.select("word", "n"), parts)
    crowded = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > block_words)
    crowded = shared.stored(crowded.select("tile", F.ceil(F.col("words") / block_words).cast("int").alias("blocks")), "crowded")
    dealt = tiled.join(crowded, "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("word", "n", "size", "part", "tile", "shard", F.least("shard", "with").alias("i"), F.greatest("shard", "with").alias("j"))
    order = ["size", "tile", "part", "i", "j"]
    return dealt.repartition("tile", "i", "j").sortWithinPartitions(*order).mapInArrow(
        _compare(parts), "word string, n long, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, following form to the last, from (word, form): the length of what is followed doubles in each round.
    Forms must not lead in a circle."""
    at = shared.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = shared.stored(at.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        shared.dropped(at)
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def group(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n; each word once). form is the near word of the
    largest n, the smallest of these in code-point order, if its n is `times` the word's or more; root is where forms lead.
    As n grows along forms, they never lead in a circle. Words without near words have n_near 0, no form and are their own
    root."""
    pairs = shared.stored(near_pairs(words), "near")
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                       F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("own"),
                                    F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    is_form = -F.col("best.less") >= F.col("own") * times
    best = shared.stored(best.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"),
                                     F.when(is_form, -F.col("best.less")).alias("form_n")), "best")
    shared.dropped(pairs)
    roots = _roots(best.where("form IS NOT NULL"))
    return words.join(best, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, one_in: int = 31, times: int = 10) -> DataFrame:
    """group() of count_words() of docs (doc_id, text). Other columns are ignored; without words there is no row."""
    return group(shared.stored(count_words(docs, shortest, least, one_in), "words"), times)
