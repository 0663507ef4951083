"""Jaccard join of documents on word n-grams by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundweave.llm import membership, shared
from fundweave.llm import words as W

#: Fragments of the global order: n-grams of 2 to 3 sets, of 4 to 7, and so on; the last one has no upper end.
FRAGMENTS = 6
#: N-grams of a block of sets, about.
_BLOCK_GRAMS = 1 << 18
#: Rounds in which a set is paired with one other set only.
_ROUNDS = 3
#: Bytes of text that are worked on at once.
_BLOCK = 1 << 20


def _sets(block: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-gram hashes of each text, sorted; the n + 1 offsets of the texts; a key of each set."""
    data, at = W.raw(W.column(block, "text"))
    data = W.LOWER[data]
    starts, ends, word_at = W.spans(W.NOT_BLANK[data], at)
    grams, gram_at = W.shingles(W.hashes(data, starts, ends), word_at, size)
    for low, high in zip(gram_at[:-1], gram_at[1:], strict=True):
        grams[low:high].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[gram_at[:-1][gram_at[1:] > gram_at[:-1]]] = True
    out_at = np.concatenate([[0], np.cumsum(new)])[gram_at]
    grams = grams[new]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    keys = W.mixed((total[out_at[1:]] - total[out_at[:-1]]) ^ W.mixed(np.diff(out_at).astype(np.uint64)))
    return grams, out_at, keys.view(np.int64)


def _signatures(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", _BLOCK):
            _, at, keys = _sets(block, size)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(keys), pa.array(np.diff(at))],
                                             ["doc_id", "text_hash", "key", "n"])

    return read


def _thin_segments(size: int, parts: int):
    """Half of the hash space, cut to parts. For each block of texts and part a row: which sets have n-grams that no other
    set of the block has, these n-grams as 32-bit numbers, and once each those that several have."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", _BLOCK):
            grams, at, keys = _sets(block, size)
            _, first = np.unique(keys, return_index=True)
            kept = np.zeros(len(keys), bool)
            kept[first] = True
            of = np.repeat(np.arange(len(keys)), np.diff(at))
            use = kept[of] & (grams < np.uint64(1 << 63))
            grams, of = grams[use], of[use]
            order = np.argsort(grams, kind="stable")
            grams, of = grams[order], of[order]
            edge = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, int)
            alone = np.diff(np.append(edge, len(grams))) == 1
            part = ((grams[edge] >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            short = grams[edge].astype(np.uint32)
            cut = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)):
                here = slice(cut[k], cut[k + 1])
                single = alone[here]
                own, value = of[edge[here][single]], short[here][single]
                order = np.argsort(own, kind="stable")
                who, sizes = np.unique(own, return_counts=True)
                rows.append((int(k), keys[who].tobytes(), sizes.astype(np.uint32).tobytes(), value[order].tobytes(), short[here][~single].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                ["part", "keys", "sizes", "alone", "several"])

    return read


def _unshared(parts: int):
    """Of one part: how many n-grams of each set occur in no other set; a row for each share of the keys. A false match of
    32-bit numbers within a part can only let a set pass that has to be looked at more closely."""

    def count(table: pa.Table) -> pa.Table:
        keys, sizes, alone, several = (
            np.frombuffer(b"".join(table[name].to_pylist()), kind)
            for name, kind in (("keys", np.int64), ("sizes", np.uint32), ("alone", np.uint32), ("several", np.uint32)))
        owner = np.repeat(np.arange(len(keys)), sizes)
        values, which, times = np.unique(alone, return_inverse=True, return_counts=True)
        once = (times == 1) & ~np.isin(values, several)
        number = np.bincount(owner[once[which]], minlength=len(keys)).astype(np.uint32)
        full = np.flatnonzero(number)
        share = (keys[full].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        full, cut = full[order], np.searchsorted(share[order], np.arange(parts + 1))
        own = np.flatnonzero(np.diff(cut)).tolist()
        return pa.table({"share": pa.array(own, pa.int32()),
                         "keys": pa.array([keys[full[cut[k]:cut[k + 1]]].tobytes() for k in own], pa.binary()),
                         "numbers": pa.array([number[full[cut[k]:cut[k + 1]]].tobytes() for k in own], pa.binary())})

    return count


def _summed(table: pa.Table) -> pa.Table:
    """Of one share of the keys: each set's sum over the parts."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64)
    found, which = np.unique(keys, return_inverse=True)
    numbers = np.frombuffer(b"".join(table["numbers"].to_pylist()), np.uint32)
    return pa.table({"key": found, "unshared": np.bincount(which, numbers, len(found)).astype(np.int64)})


def _whole_sets(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", _BLOCK):
            grams, at, keys = _sets(block, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.diff(at)), pa.LargeListArray.from_arrays(at, grams.view(np.int64)).cast(pa.list_(pa.int64()))],
                ["key", "n", "grams"])

    return read


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of sets: its own key, and the sets' keys, sizes and n-grams."""
    for batch in batches:
        keys, sets = batch.column(0).to_numpy(), batch.column(2)
        at = sets.offsets.to_numpy().astype(np.int64)
        flat = sets.flatten().to_numpy()
        step = max(1, int(len(keys) * _BLOCK_GRAMS / max(len(flat), 1)))
        for i in range(0, len(keys), step):
            own = keys[i:i + step]
            low, high = at[i] - at[0], at[min(i + step, len(keys))] - at[0]
            name = int(W.mixed(W.mixed(own.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), *(pa.array([x.tobytes()], pa.binary()) for x in (own, np.diff(at[i:i + step + 1]), flat[low:high]))],
                ["block", "keys", "sizes", "grams"])


def _block_parts(parts: int):
    """The different n-grams of a block, sorted, with the number of its sets that have them; a row for each part of the
    hash space."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, times = np.unique(np.frombuffer(grams.as_py(), np.uint64), return_counts=True)
                part = ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(part, np.arange(parts + 1))
                full = np.flatnonzero(np.diff(cut)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()),
                     pa.array([values[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary()),
                     pa.array([times[cut[k]:cut[k + 1]].astype(np.uint32).tobytes() for k in full], pa.binary())],
                    ["part", "block", "grams", "times"])

    return read


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one part: in how many sets each n-gram of each block is, in the block's order."""
    grams = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in table["times"].to_pylist()])
    _, which = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(which, times)[which].astype(np.uint32)
    ends = np.cumsum([len(x) for x in grams])
    return pa.table({"block": table["block"], "part": table["part"],
                     "times": pa.array([total[e - len(x):e].tobytes() for e, x in zip(ends, grams, strict=True)], pa.binary())})


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, fragment, grams, place) of each set's n-grams that other sets have too, in the global order: by the
    number of sets, then by hash. place counts those before, with the ones that no other set has, which come first."""
    for batch in batches:
        for keys, sizes, grams, answers in zip(*(batch.column(k) for k in range(4)), strict=True):
            keys, sizes, grams = (np.frombuffer(x.as_py(), np.int64) for x in (keys, sizes, grams))
            found = sorted(answers.as_py(), key=lambda x: x["part"])
            number = np.frombuffer(b"".join(x["times"] for x in found), np.uint32)
            values, which = np.unique(grams.view(np.uint64), return_inverse=True)
            number = number[which].astype(np.int64)
            of = np.repeat(np.arange(len(keys)), sizes)
            alone = np.bincount(of[number == 1], minlength=len(keys))
            use = np.flatnonzero(number > 1)
            order = use[np.lexsort((grams[use], number[use], of[use]))]
            of, number, grams = of[order], number[order], grams[order]
            fragment = np.minimum(np.log2(np.maximum(number, 1)).astype(np.int64), FRAGMENTS) - 1
            new = np.flatnonzero(np.append(True, (fragment[1:] != fragment[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, int)
            first = np.searchsorted(of, np.arange(len(keys)))
            owner = of[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner]), pa.array(sizes[owner]), pa.array(fragment[new], pa.int32()),
                 pa.LargeListArray.from_arrays(np.append(new, len(grams)), grams).cast(pa.list_(pa.int64())),
                 pa.array(new - first[owner] + alone[owner])],
                ["key", "n", "fragment", "grams", "place"])


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Linked ones of the pairs (a, b). Overlaps are counted fragment by fragment and summed per pair."""
    of_a = segments.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    of_b = segments.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    partial = pairs.join(of_b, "b").join(of_a, ["a", "fragment"])
    partial = partial.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
    summed = partial.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("common").alias("common"))
    return summed.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """key and label of all keys in links (a, b): the smallest key that can be reached. Labels go to neighbours, then each
    takes its label's label, so that long chains end after few rounds. Each round is a stored table."""
    edges = shared.stored(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shared.stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["key"] == near["a"]).select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("key").alias("label"), F.col("label").alias("up"))
        new = shared.stored(moved.join(up, "label", "left").select("key", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        done = new.where("was <> label").isEmpty()
        shared.dropped(labels)
        labels = new.select("key", "label")
        if done:
            shared.dropped(edges)
            return labels


def _close(a: str, b: str, percent: int) -> Column:
    """Sizes are near enough, and what follows the shared n-gram in the order is enough for the least overlap."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = F.ceil(percent * (n_a + n_b) / F.lit(100 + percent))
    rest = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (rest >= least)


def _apart(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries with the labels of their components, of n-grams whose sets aren't all in one."""
    placed = entries.join(found, "key", "left").withColumn("label", F.coalesce("label", "key"))
    split = placed.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return placed.join(split.select("gram"), "gram", "left_semi")


def _one_each(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each set with one set of another component that shares an n-gram. In even turns it is the set with
    the fewest rarer n-grams: the text that a group's near copies come from has hardly any. In odd turns it is any."""
    order = F.xxhash64("key", F.lit(turn)) if turn % 2 else F.col("place")
    hubs = placed.groupBy("gram", "near_size").agg(F.min(F.struct(order.alias("o"), "key", "n", "place", "label")).alias("h"))
    near = placed.alias("e").join(hubs.select("gram", "near_size", "h.*").alias("h"), ["gram", "near_size"])
    near = near.where((F.col("e.label") != F.col("h.label")) & _close("e", "h", percent))
    picked = near.groupBy(F.col("e.key").alias("key")).agg(F.min(F.struct("h.o", "h.key")).alias("h"))
    return picked.select(F.least("key", "h.key").alias("a"), F.greatest("key", "h.key").alias("b")).distinct()


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets that share an n-gram and are in different components. Of each n-gram, only sets outside the
    component that most of its sets are in look for others."""
    sizes = placed.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("gram").agg(F.max(F.struct("size", "label"))["label"].alias("most"))
    few = placed.join(most, "gram").where("label <> most").drop("most")
    near = few.alias("a").join(placed.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.label") != F.col("b.label")) & _close("a", "b", percent))
    return near.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id that links lead to.

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word n-grams. A text of fewer
    words is one n-gram; a null text, or one without words, has none and is linked with nothing. Copies of a set are one
    key, so repeated rows and ties share a component; rows with a null id join components but don't name them. Other
    columns are ignored.

    1. Sets get 64-bit keys (n-grams are compared by 64-bit hashes).
    2. In half of the hash space, cut into parts, each part counts the n-grams of a set that no other set has. More than
       a linked set can have, and the set is out. Blocks of texts send an n-gram that several of them have only once.
    3. N-grams of the sets left are ordered by the number of sets that have them, rare ones first. Blocks of sets send each
       n-gram once. Of linked sets, the first n - (least overlap) + 1 n-grams share one; these make candidates.
    4. In a few rounds each set is paired with one other set. Overlaps of pairs are counted in each fragment of the order
       and summed. Linked pairs give components.
    5. Sets that share such an n-gram and aren't in one component yet are all paired and counted in the same way. So a group
       of thousands of near copies needs few pairs within it, and no link that could join components is lost.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = shared.stored(texts.mapInArrow(_signatures(size), f"doc_id {kind}, text_hash long, key long, n long"), "signatures")
    classes = rows.where("n > 0").groupBy("key").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("least_id"), F.min(F.struct("text_hash", "doc_id")).alias("one"))

    thin = texts.select("text").mapInArrow(_thin_segments(size, parts), "part int, keys binary, sizes binary, alone binary, several binary")
    unshared = thin.groupBy("part").applyInArrow(_unshared(parts), "share int, keys binary, numbers binary")
    unshared = unshared.groupBy("share").applyInArrow(_summed, "key long, unshared long")
    left = classes.join(unshared, "key", "left").where(100 * F.coalesce("unshared", F.lit(0)) <= (100 - percent) * F.col("n"))
    left = shared.stored(left.select("key", F.col("one.text_hash").alias("text_hash"), F.col("one.doc_id").alias("one_id")), "left")

    wanted = membership.likely(texts, F.col("text_hash"), left, "text_hash").alias("t").join(
        left.alias("l"), (F.col("t.text_hash") == F.col("l.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("l.one_id")), "left_semi")
    sets = wanted.select("text").mapInArrow(_whole_sets(size), "key long, n long, grams array<long>").dropDuplicates(["key"])
    sets = shared.stored(sets, "sets")
    blocks = shared.stored(sets.mapInArrow(_blocks, "block long, keys binary, sizes binary, grams binary"), "blocks")
    answers = blocks.select("block", "grams").mapInArrow(_block_parts(parts), "part int, block long, grams binary, times binary")
    answers = answers.groupBy("part").applyInArrow(_frequencies, "block long, part int, times binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("part", "times")).alias("answers"))
    segments = blocks.join(answers, "block").select("keys", "sizes", "grams", "answers").mapInArrow(
        _in_order, "key long, n long, fragment int, grams array<long>, place long")
    segments = shared.stored(segments, "segments")
    shared.dropped(sets, blocks)

    longest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = segments.where(F.col("place") < longest).select(
        "key", "n", F.posexplode(F.slice("grams", F.lit(1), (longest - F.col("place")).cast("int"))).alias("pos", "gram"), "place")
    first = first.select("gram", "key", "n", (F.col("place") + F.col("pos")).alias("place"),
                         F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).alias("near_size"))
    several = first.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    entries = shared.stored(first.join(several, "gram", "left_semi"), "entries")

    links, tested = None, None
    found = entries.select("key", F.col("key").alias("label")).limit(0)
    for turn in range(_ROUNDS):
        placed = shared.stored(_apart(entries, found), "placed")
        pairs = shared.stored(_one_each(placed, percent, turn), "pairs")
        new = shared.stored(_overlaps(pairs, segments, percent), "links")
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = new if links is None else links.unionAll(new)
        found = components(links)
    placed = shared.stored(_apart(entries, found), "placed")
    more = _across(placed, percent).join(tested, ["a", "b"], "left_anti")
    links = links.unionAll(shared.stored(_overlaps(more, segments, percent), "links"))
    found = components(links)

    named = classes.select("key", "least_id").join(found, "key")
    named = named.join(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "label").select("key", "component_id")
    alone = classes.select("key", "least_id").join(named, "key", "left").select("key", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(alone, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
