"""Benchmark decontamination: a generalised suffix automaton of the benchmark's words reads the words of documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundweave.llm import words as W

#: Words of benchmark items in one automaton. More items are more automata, each read by the documents in turn.
BLOCK_WORDS = 50_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CAPITALS = bytes(W.LOWER)
_GRAM = 4
_FILTER_BITS = 22


def item_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return _WORD.findall((text or "").encode().translate(_CAPITALS))


class Automaton:
    """Generalised suffix automaton of items. A window is `window` consecutive words of an item, or all words of an item
    of fewer."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.size, self.link, self.step = [0], [-1], [{}]
        self.ids: list[str] = []
        self.within: dict[int, list[int]] = {}  # state -> items, for states that hold a string of `window` words
        self.whole: dict[int, list[tuple[int, int]]] = {}  # state -> (words, item) of short items that end there
        kept = [(name, words) for name, words in items if words]
        for _, words in kept:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for number, (name, words) in enumerate(kept):
            self.ids.append(name)
            state = 0
            for word in words:
                state = self.step[state][word]
                if len(words) >= window:
                    self._mark(state, number)
            if len(words) < window:
                self.whole.setdefault(state, []).append((len(words), number))
        self.shortest = min((min(len(words), window) for _, words in kept), default=window)
        self.gram = min(_GRAM, self.shortest)
        self.grams = self._grams([words for _, words in kept])
        self.above = [-1] * len(self.size)  # the nearest state up the links at which short items end
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            up = self.link[state]
            self.above[state] = up if up in self.whole else self.above[up]

    def _new(self, size: int, link: int, step: dict[bytes, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A state of its own for the strings of target that are one word longer than those of state."""
        copy = self._new(self.size[state] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        target = self.step[last].get(word)
        if target is not None:
            return target if self.size[target] == self.size[last] + 1 else self._split(last, word, target)
        added = self._new(self.size[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = added
            state = self.link[state]
        if state >= 0:
            target = self.step[state][word]
            self.link[added] = target if self.size[target] == self.size[state] + 1 else self._split(state, word, target)
        return added

    def _mark(self, state: int, number: int) -> None:
        while self.size[state] >= self.window:
            own = self.within.setdefault(state, [])
            if own and own[-1] == number:
                break
            own.append(number)
            state = self.link[state]

    def _grams(self, items: list[list[bytes]]) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for words in items:
            data = np.frombuffer(b" ".join(words), np.uint8)
            ends = np.cumsum([len(word) + 1 for word in words]) - 1
            starts = ends - [len(word) for word in words]
            found.append(W.shingles(W.hashes(data, starts, ends), np.array([0, len(words)]), self.gram)[0])
        return np.unique(np.concatenate(found))

    def read(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Spans of words that lie in windows, the items these belong to, and the length of the longest match."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state, length, longest = 0, 0, 0
        for k, word in enumerate(words):
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.step[state]:
                state, length = self.step[state][word], length + 1
            longest = max(longest, length)
            hit = 0
            if length >= self.window:
                at = state
                while self.size[self.link[at]] >= self.window:
                    at = self.link[at]
                hit = self.window
                items.update(self.within.get(at, ()))
            at = state
            while at >= 0:
                for size, number in self.whole.get(at, ()):
                    if size <= length:
                        hit = max(hit, size)
                        items.add(number)
                at = self.above[at]
            if hit:
                low = k + 1 - hit
                if spans and low <= spans[-1][1]:
                    low = min(low, spans.pop()[0])
                    while spans and low <= spans[-1][1]:
                        low = min(low, spans.pop()[0])
                spans.append((low, k + 1))
        return spans, items, longest


def _stretches(words: np.ndarray, at: np.ndarray, automaton: Automaton, table: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches in which every run of `gram` words is one of the benchmark, if they are
    as long as the shortest window. A window can't lie elsewhere."""
    size = automaton.gram
    grams, gram_at = W.shingles(words, at, size)
    likely = np.flatnonzero(table[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(automaton.grams, grams[likely]), len(automaton.grams) - 1)
    likely = likely[automaton.grams[place] == grams[likely]]
    if not len(likely):
        return []
    text = np.searchsorted(gram_at, likely, "right") - 1
    edge = np.flatnonzero((np.diff(likely) != 1) | (np.diff(text) != 0)) + 1
    first, last = np.append(0, edge), np.append(edge, len(likely)) - 1
    long_enough = last - first + 1 >= automaton.shortest - size + 1
    first, last = first[long_enough], last[long_enough]
    low = likely[first] - gram_at[text[first]]
    stop = likely[last] - gram_at[text[first]] + size
    return [(t, a, min(b, int(at[t + 1] - at[t]))) for t, a, b in zip(text[first].tolist(), low.tolist(), stop.tolist(), strict=True)]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _automata(items: DataFrame, window: int, block_words: int) -> Iterator[Broadcast]:
    """One automaton for each block of items, broadcast."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text") - F.length(F.translate("text", " \n\t", "")) + 1)).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for block in range(n_blocks):
        rows = items.where(share == block).collect()
        found = sorted(((r["item_id"], item_words(r["text"])) for r in rows), key=lambda x: (x[0] is None, x))
        yield items.sparkSession.sparkContext.broadcast(Automaton(found, window))


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_spans (maximal runs of words in windows, as [first, end) pairs, one
    after the other), byte_spans (the same as byte positions), items (ids as strings, sorted, of items with windows that
    occur), longest (words of the longest match in a stretch that can hold a window).

    `items` (item_id, text) is divided by its ids' hashes into blocks of about block_words words; one automaton of that
    size is built and broadcast for each, and the documents pass all of them without a shuffle. Null texts have no words;
    items without words match nothing; items with a null id hit, but can't be listed. Repeated items are listed once.
    """
    found = _through_automata(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), items, window, block_words)
    return found.drop("text").withColumnRenamed("doc_id", id_column)


def _through_automata(texts: DataFrame, items: DataFrame, window: int, block_words: int) -> DataFrame:
    """texts, whose columns don't clash, with n_words, word_spans, byte_spans, items and longest."""
    found = texts.withColumns({
        "n_words": F.lit(0).cast("long"), "word_spans": F.array().cast("array<long>"), "byte_spans": F.array().cast("array<long>"),
        "items": F.array().cast("array<string>"), "longest": F.lit(0).cast("long")})
    fields = found.schema
    for known in _automata(items, window, block_words):
        found = found.mapInArrow(_reader(known), fields)
    return found


def _reader(known):
    """Adds to the columns of each batch what one automaton finds in its texts; others pass."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = known.value
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[(automaton.grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        for block in W.blocks(batches, "text"):
            data, at = W.raw(W.column(block, "text"))
            data = W.LOWER[data]
            starts, ends, word_at = W.spans(W.ALPHANUMERIC[data], at)
            per_text: dict[int, tuple[list, list, set, int]] = {}
            stretches = _stretches(W.hashes(data, starts, ends), word_at, automaton, table) if len(automaton.grams) else []
            for text, low, high in stretches:
                first = word_at[text]
                own = [data[a:b].tobytes() for a, b in zip(starts[first + low:first + high], ends[first + low:first + high], strict=True)]
                spans, numbers, longest = automaton.read(own)
                entry = per_text.setdefault(text, ([], [], set(), 0))
                for a, b in spans:
                    entry[0].append((low + a, low + b))
                    entry[1].append((int(starts[first + low + a] - at[text]), int(ends[first + low + b - 1] - at[text])))
                entry[2].update(automaton.ids[k] for k in numbers if automaton.ids[k] is not None)
                per_text[text] = (*entry[:3], max(entry[3], longest))
            was = {name: block.column(name) for name in ("word_spans", "byte_spans", "items", "longest")}
            out = {name: was[name].to_pylist() for name in was}
            for text, (spans, places, ids, longest) in per_text.items():
                for name, new in (("word_spans", spans), ("byte_spans", places)):
                    flat = out[name][text]
                    out[name][text] = [x for pair in _united([*zip(flat[::2], flat[1::2], strict=True), *new]) for x in pair]
                out["items"][text] = sorted({*out["items"][text], *ids})
                out["longest"][text] = max(out["longest"][text], longest)
            new = {"n_words": pa.array(np.diff(word_at)), "longest": pa.array(out["longest"], pa.int64()),
                   "word_spans": pa.array(out["word_spans"], pa.list_(pa.int64())),
                   "byte_spans": pa.array(out["byte_spans"], pa.list_(pa.int64())), "items": pa.array(out["items"], pa.list_(pa.string()))}
            names = block.schema.names
            yield pa.RecordBatch.from_arrays([new.get(name, block.column(k)) for k, name in enumerate(names)], names)

    return read


def hit_words() -> Column:
    """Words in windows, of a row of find_overlaps."""
    signed = F.transform("word_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(share: int = 20) -> Column:
    """At least one word in `share` lies in a window."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs, with their columns, that aren't contaminated: fewer than one word in `share` lies in a window, or
    none. Null texts have no words and stay, as does everything if no item has words; rows that repeat are judged each.
    Rows pass the automata in slices of bounded bytes; nothing is joined or shuffled."""
    names = [f"_own{k}" if name != "text" else name for k, name in enumerate(docs.columns)]
    found = _through_automata(docs.toDF(*names), items, window, block_words)
    return found.where(~is_contaminated(share)).select(*names).toDF(*docs.columns)


def without_spans(docs: DataFrame, items: DataFrame, window: int = 13, longest_span: int = 13, share: int = 20) -> DataFrame:
    """doc_id and text of documents of unique doc_id, cleaned: where windows cover a `share`-th of the words or more, the
    document goes; else each span of more than `longest_span` words is taken out of the text, down to single bytes."""
    found = find_overlaps(docs, items, window).where(~is_contaminated(share)).select("doc_id", "word_spans", "byte_spans")

    @F.pandas_udf("string")
    def cut(texts, word_spans, byte_spans):
        def one(text, words, places):
            data, kept, at = (text or "").encode(), [], 0
            for k in range(0, len(words), 2):
                if words[k + 1] - words[k] > longest_span:
                    kept.append(data[at:places[k]])
                    at = places[k + 1]
            return b"".join([*kept, data[at:]]).decode() if at else text
        return texts.combine(word_spans, lambda a, b: (a, b)).combine(byte_spans, lambda ab, c: one(*ab, c))

    joined = docs.join(found, "doc_id")
    return joined.select("doc_id", cut("text", "word_spans", "byte_spans").alias("text"))
