"""Removal of long byte strings that occur more than once: prefix doubling of position ranks, distributed by Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundweave.llm import membership, shared
from fundweave.llm import words as W

#: Starts of a text that are worked on at once, so that very long texts take bounded memory.
_STEP = 1 << 20
_PLACE_BITS = 21
#: Bytes of text that are worked on at once.
_BLOCK = 1 << 20


class _Ranks:
    """Ranks, as 64-bit hashes, of all strings of a text's bytes: equal strings have equal ranks in all texts."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = W._power_tables(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return W.mixed(((self.total[ends] - self.total[starts]) * self.down[starts]) ^ (ends - starts).astype(np.uint64))


def _least_of_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive numbers."""
    n = len(x) - width + 1
    y = np.append(x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def _intervals(length: int):
    """For each different text of a block: runs of starts [low, high] whose strings of `length` bytes have the same
    sample, the string of 3/4 of that length inside that has the least rank, the first of equals; and the rank of all that
    the run covers. Runs of equal samples that follow each other, as in a text that repeats one word, are one: looped."""
    size = max(length * 3 // 4, 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", _BLOCK):
            data, at = W.raw(W.column(block, "text"))
            keys = block.column(0).to_numpy()
            _, first = np.unique(keys, return_index=True)
            out: list[tuple] = [(*(np.zeros(0, np.int64),) * 5, np.zeros(0, bool))]
            for k in first[np.diff(at)[first] >= length].tolist():
                text = data[at[k]:at[k + 1]]
                for low in range(0, len(text) - length + 1, _STEP):
                    part = text[low:low + _STEP + length - 1]
                    ranks, starts = _Ranks(part), np.arange(len(part) - size + 1)
                    rank = ranks.of(starts, starts + size)
                    place = np.uint64((1 << _PLACE_BITS) - 1)
                    least = (_least_of_windows(rank & ~place | starts.astype(np.uint64), length - size + 1) & place).astype(np.int64)
                    sample = rank[least]
                    edge = np.flatnonzero(np.append(True, sample[1:] != sample[:-1]))
                    last = np.append(edge[1:], len(least)) - 1
                    whole = ranks.of(edge, last + length)
                    out.append((np.full(len(edge), keys[k]), edge + low, last + low, sample[edge].view(np.int64),
                                whole.view(np.int64), least[edge] != least[last]))
            names = ["key", "low", "high", "sample", "whole", "looped"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return read


def _pairs(length: int):
    """Starts in the intervals of a text, with the pair of ranks at each and at the growing offset as one rank: together
    they are the rank of the string of `length` bytes. A pair that the text has several times comes once; all its starts
    follow as runs [low, high] without a pair, as they are known to repeat."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(length * 3 // 4, 1)
        for block in W.blocks(batches, "text", _BLOCK):
            data, at = W.raw(W.column(block, "text"))
            lists = block.column(2)
            item_at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            low, high = (lists.flatten().field(name).to_numpy() for name in ("low", "high"))
            for k, key in enumerate(block.column(0).to_pylist()):
                text = data[at[k]:at[k + 1]]
                a, b = low[item_at[k]:item_at[k + 1]], high[item_at[k]:item_at[k + 1]]
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                i = 0
                while i < len(a):  # intervals near each other together
                    j = max(i + 1, int(np.searchsorted(b, a[i] + _STEP)))
                    base = int(a[i])
                    ranks = _Ranks(text[base:int(b[j - 1]) + length])
                    n = b[i:j] - a[i:j] + 1
                    p = np.repeat(a[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum()) - base
                    first, second = ranks.of(p, p + size), ranks.of(p + length - size, p + length)
                    pair = W.mixed(first ^ W.mixed(second + np.uint64(1)))
                    found, at_first, which, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                    known = np.sort(p[times[which] > 1])
                    edge = np.flatnonzero(np.append(True, np.diff(known) != 1)) if len(known) else np.zeros(0, int)
                    low_at = np.append(p[at_first], known[edge]) + base
                    high_at = np.append(p[at_first], np.append(known[edge[1:] - 1], known[-1:])) + base
                    new = pa.array(np.arange(len(low_at)) >= len(found))
                    yield pa.RecordBatch.from_arrays(
                        [pc.if_else(new, None, pa.array(np.append(found.view(np.int64), np.zeros(len(edge), np.int64)))),
                         pa.array(np.full(len(low_at), key)), pa.array(low_at), pa.array(high_at)], ["pair", "key", "low", "high"])
                    i = j

    return read


def _repeated(rows: DataFrame, rank: str, also: Column | None = None) -> DataFrame:
    """Ranks that stand at two places or more, or for which `also` holds. Each task sends a rank once, however often it
    has it."""
    place = F.xxhash64("key", "low")
    also = F.lit(False) if also is None else also
    found = rows.groupBy(rank).agg(F.min(place).alias("a"), F.max(place).alias("b"), also.alias("also"))
    return found.where("a <> b OR also").select(rank)


def repeated_starts(docs: DataFrame, length: int = 400) -> DataFrame:
    """key (xxhash64 of a text) and ranges (array of low, high): the starts of strings of `length` bytes that also start
    elsewhere in docs (doc_id, text), in the same text or another. Texts without such a string have no row.

    1. A text that several rows have repeats whole. Other steps see each different text once.
    2. Of every `length` consecutive bytes one string of 3/4 of the length is the sample: the one of the least rank. Equal
       strings have equal samples, so the first ranks are taken of about two positions in a hundred only. Spark groups
       them; where the sample's rank is unique, all starts that it stands for are unique and out.
    3. The rest is ranked by pairs at growing offsets: first the whole strings that the starts of one sample cover, beyond
       the threshold. Where these repeat, all their starts do.
    4. The others, at the ends of repeated passages, are ranked one by one: the pair of ranks at a start and a quarter of
       the length further is the rank of `length` bytes. Starts of unique pairs are out, and the threshold is reached.

    Ranks are 64-bit hashes of the bytes; they are the same on every executor and need no numbering.
    """
    key = F.xxhash64("text").alias("key")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("doc_id", key, F.xxhash64(F.lit(1), "text").alias("check"), F.octet_length("text").alias("n"))
    known = shared.stored(rows.where(F.col("n") >= length).groupBy("key", "check").agg(
        F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("one_id"), F.max("n").alias("n")), "texts")
    copied = known.where("times > 1").select("key", F.lit(True).alias("copied"), "n")

    samples = shared.stored(texts.where(F.octet_length("text") >= length).select(key, "text").mapInArrow(
        _intervals(length), "key long, low long, high long, sample long, whole long, looped boolean"), "samples")
    again = shared.stored(_repeated(samples, "sample", F.max("looped")), "ranks")
    rest = membership.likely(samples, F.col("sample"), again, "sample").join(again, "sample", "left_semi").dropDuplicates(["key", "low"])
    rest = shared.stored(rest.join(copied.select("key", "copied"), "key", "left"), "rest")
    shared.dropped(samples, again)

    wholes = _repeated(rest, "whole").withColumn("resolved", F.lit(True))
    rest = shared.stored(rest.join(wholes, "whole", "left"), "rest")
    own = F.col("copied").isNull()
    covered = rest.where(own & F.col("resolved")).select("key", "low", "high")
    open_samples = rest.where(own & F.col("resolved").isNull()).select("sample").distinct()
    members = rest.join(open_samples, "sample", "left_semi")
    one_of_each = members.where("resolved").groupBy("whole").agg(F.min(F.struct("key", "low", "high")).alias("one"))
    single = members.where("resolved IS NULL").select("key", "low", "high").unionAll(one_of_each.select("one.*"))
    lists = single.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("intervals"))
    lists = shared.stored(lists.join(known.groupBy("key").agg(F.min("one_id").alias("one_id")), "key"), "intervals")

    long_enough = texts.select("doc_id", key, "text").where(F.octet_length("text") >= length)
    needed = membership.likely(long_enough, F.col("key"), lists, "key").alias("t").join(
        lists.alias("l"), (F.col("t.key") == F.col("l.key")) & F.col("t.doc_id").eqNullSafe(F.col("l.one_id")))
    pairs = shared.stored(needed.select("t.key", "t.text", "l.intervals").mapInArrow(_pairs(length), "pair long, key long, low long, high long"), "pairs")
    fine = pairs.join(_repeated(pairs.where("pair IS NOT NULL"), "pair"), "pair", "left_semi")
    fine = fine.unionAll(pairs.where("pair IS NULL")).join(copied, "key", "left_anti").select("key", "low", "high").distinct()

    whole_texts = copied.select("key", F.lit(0).cast("long").alias("low"), (F.col("n") - length).cast("long").alias("high"))
    found = covered.unionAll(fine).unionAll(whole_texts).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    found = shared.stored(found, "ranges")
    shared.dropped(rest, lists, pairs, known)
    return found


def with_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with a column _ranges from repeated_starts, null for texts without any. Only texts that may have some are
    shuffled."""
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = membership.marked(keyed, F.col("_key"), found, "key", "_may_have")
    hit = keyed.where("_may_have").join(found.select(F.col("key").alias("_key"), F.col("ranges").alias("_ranges")), "_key", "left")
    none = keyed.where("NOT _may_have").withColumn("_ranges", F.lit(None).cast(found.schema["ranges"].dataType))
    return hit.unionByName(none).drop("_key", "_may_have")


def spans(ranges: list | np.ndarray | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of `length` bytes at these ranges of starts cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in (() if ranges is None else ranges)):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high + length)
        else:
            out.append((low, high + length))
    return out


def kept_bytes(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for low, high in removed:
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]])


def digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256. A null text is empty; a text that two
    rows have, with the same doc_id or not, repeats. Other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, kept = [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                data, out = (text.as_py() or "").encode(), spans(ranges.as_py(), length)
                n.append(len(data))
                removed.append(sum(high - low for low, high in out))
                runs.append(len(out))
                kept.append(hashlib.sha256(kept_bytes(data, out)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    return with_ranges(docs, repeated_starts(docs, length)).select("doc_id", "text", "_ranges").mapInArrow(
        read, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, length: int = 400, changed: str | None = None) -> DataFrame:
    """docs with their columns, repeated strings taken out of text, and in a column `changed`, if named, whether something
    was. A character of which only some bytes go goes whole. A null text stays null; of rows that repeat each loses its
    text, if it is as long as `length`. Rows go through Arrow; only texts that change become Python objects."""
    flag = changed or "_changed"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, ranges = batch.columns
            place = batch.schema.get_field_index("text")
            text = own[place]
            hit = pc.and_(pc.is_valid(ranges), pc.is_valid(text))
            new = [kept_bytes(t.encode(), spans(r, length)).decode(errors="ignore")
                   for t, r in zip(text.filter(hit).to_pylist(), ranges.filter(hit).to_pylist(), strict=True)]
            own[place] = pc.replace_with_mask(text, hit, pa.array(new, text.type)) if new else text
            yield pa.RecordBatch.from_arrays([*own, hit], [*batch.schema.names[:-1], flag])

    marked = with_ranges(docs, repeated_starts(docs, length)).select(*docs.columns, "_ranges")
    schema = T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])
    cleaned = marked.mapInArrow(cut, schema)
    return cleaned if changed else cleaned.drop(flag)
