"""Secrets in texts: fixed formats, and values in the place of a credential that would cost many guesses. The cost is the
least over all segmentations of a value into words, dates, repeats, keyboard walks and brute-force spans."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundweave.llm import words as W

#: Kinds in the order in which spans of the same start are listed. The last one is found by guess cost.
KINDS = ("assign", "access", "hex", "guess")
MIN_BITS, MIN_RATE = 40.0, 3.5

# The formats.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so shorter ones need no look

#: Places where a value is a credential: after a name and a sign, after "bearer", between user and host.
_NAMES = (r"passw(?:or)?d|passphrase|passcode|(?<![a-z])pass|(?<![a-z])pwd|secret|token|credentials?|"
          r"(?:api|access|private|auth)[ _-]?key|(?<![a-z])auth(?:orization)?")
_CONTEXT = re.compile(
    rf"""(?:{_NAMES})["'\])]?\x20*(?:=>|:=|==|[:=])\x20*(?:(?:bearer|basic)\x20+)?(?!["']?[a-z][a-z0-9+.-]*://)(?:"(?P<a>[^"\s]+)"|'(?P<b>[^'\s]+)'|(?P<c>[^\s"']+))"""
    r"|(?<![a-z])bearer\x20+(?P<d>[a-z0-9._~+/=-]+)"
    r"|://[^\s/:@]{1,256}:(?P<e>[^\s/@]{1,256})@", re.ASCII | re.IGNORECASE)
#: What a text must hold to have any span; letters in either case.
_LIKELY = (r"(?i)passw|passphrase|passcode|pass[^a-z]|pwd|secret|token|credential|"
           r"(?:api|access|private|auth)[ _-]?key|auth|bearer|://[^\s/:@]+:[^\s/@]+@")
_CLOSING = ".,;:!?)]}>"
#: What stands for a value that is elsewhere: a variable or a field to fill in.
_REFERENCE = re.compile(r"\$?\{.*|\$[A-Za-z_]\w*|<.*|\[.*|%[(\w].*", re.ASCII | re.DOTALL)

# Keys of a keyboard as pairs without and with shift, row by row; passwords that are tried first.
_ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), ("qwertyuiop[]\\", "QWERTYUIOP{}|"), ("asdfghjkl;'", "ASDFGHJKL:\""), ("zxcvbnm,./", "ZXCVBNM<>?"))
_COMMON = ("password passwd secret admin administrator root login welcome letmein master default changeme guest test user "
           "pass dragon monkey sunshine princess football baseball shadow superman batman trustno iloveyou hello access "
           "example sample none null true false").split()
_LEET = str.maketrans("4@83103$57", "aabeioessT".lower())

_LONGEST_WORD, _LONGEST_UNIT = 24, 24
_OPEN = math.log2(5)  # which kind of span comes next
_DAY, _YEARS = math.log2(365), math.log2(150)

_YEAR = r"(?:19\d\d|20[0-4]\d)"
_MONTH, _D = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_DATES = [
    (re.compile(rf"{_YEAR}(?P<s>[-/._ ]){_MONTH}(?P=s){_D}|(?:{_D}(?P<t>[-/._ ]){_MONTH}|{_MONTH}(?P<u>[-/._ ]){_D})(?:(?(t)(?P=t)|(?P=u))){_YEAR}", re.ASCII), _DAY + _YEARS + 2),
    (re.compile(rf"{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2]){_YEAR}", re.ASCII), _DAY + _YEARS),
    (re.compile(r"\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d\d", re.ASCII), _DAY + math.log2(100)),
    (re.compile(_YEAR, re.ASCII), _YEARS),
]


def _neighbours() -> dict[str, dict[str, tuple[int, int]]]:
    """For each character those on a touching key, or next in the alphabet, with the direction."""
    places = {c: (2 * x + y, y) for y, (low, high) in enumerate(_ROWS) for row in (low, high) for x, c in enumerate(row)}
    steps = {(2, 0), (-2, 0), (1, 1), (-1, 1), (1, -1), (-1, -1)}
    near = {a: {b: (q[0] - p[0], q[1] - p[1]) for b, q in places.items() if (q[0] - p[0], q[1] - p[1]) in steps} for a, p in places.items()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    for alphabet in (letters, letters.upper()):
        for a, b in zip(alphabet, alphabet[1:]):
            near[a].setdefault(b, (9, 9))
            near[b].setdefault(a, (-9, -9))
    return near


_NEAR = _neighbours()
_KEYS, _TURN = math.log2(len(_NEAR)), math.log2(6)


def load_words(path: str) -> dict[str, float]:
    """Words of three letters or more with the bits of their rank: common passwords first, then whole words of a tokenizer's
    vocabulary in its order, which is by frequency."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    whole = (token[:-4] for token in sorted(vocabulary, key=vocabulary.get) if token.endswith("</w>"))
    ranked = dict.fromkeys([*_COMMON, *(w for w in whole if len(w) >= 3 and w.isalpha())])
    return {word: math.log2(rank) for rank, word in enumerate(ranked, 2)}


def _char_bits(c: str) -> float:
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return math.log2(100)


def _case_bits(text: str) -> float:
    upper = sum(c.isupper() for c in text)
    if not upper:
        return 0.0
    if upper == len(text) or (upper == 1 and text[0].isupper()):
        return 1.0
    return math.log2(math.comb(len(text), upper) + 1)


def spans_of(value: str, words: dict[str, float], units: dict[str, float] | None = None) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, bits) of all spans but the brute-force ones: words, plain or with digits and signs for letters;
    dates; and from each start the longest repeat of each unit and the longest walk over at least three keys. `units`
    remembers the bits of repeated units."""
    units = {} if units is None else units
    n, plain = len(value), "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    letters = plain.translate(_LEET)
    longest = min(n, _LONGEST_WORD)
    walk, turns = [0] * n, [0] * n
    again = {u: [0] * (n + 1) for u in range(1, min(_LONGEST_UNIT, n // 2) + 1)}
    for i in range(n - 2, -1, -1):
        way = _NEAR.get(value[i], {}).get(value[i + 1])
        if way:
            turned = walk[i + 1] > 0 and way != _NEAR[value[i + 1]][value[i + 2]]
            walk[i], turns[i] = walk[i + 1] + 1, turns[i + 1] + turned
        for u, run in again.items():
            if i + u < n and value[i] == value[i + u]:
                run[i] = run[i + 1] + 1
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for form in {plain[i:j], letters[i:j]}:
                bits = words.get(form)
                if bits is not None:
                    changed = sum(a != b for a, b in zip(form, plain[i:j]))
                    yield i, j, "word", bits + _case_bits(value[i:j]) + changed
        if value[i] in "0123456789":
            for pattern, bits in _DATES:
                match = pattern.match(value, i)
                if match:
                    yield i, match.end(), "date", bits
        for u, run in again.items():
            if run[i] >= u:
                times = run[i] // u + 1
                unit = value[i:i + u]
                if unit not in units:
                    units[unit] = guess_bits(unit, words, units) if u > 1 else _char_bits(unit)
                yield i, i + u * times, "repeat", units[unit] + math.log2(times)
        if walk[i] >= 2:
            yield i, i + walk[i] + 1, "walk", _KEYS + math.log2(walk[i] + 1) + (turns[i] + 1) * _TURN


def guess_bits(value: str, words: dict[str, float], units: dict[str, float] | None = None) -> float:
    """Bits of the guesses for a value: the least sum over its segmentations of the bits of the spans, and of which kind
    each one is. Brute force costs each character's class."""
    n = len(value)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, end, _, bits in spans_of(value, words, units):
        ending[end].append((start, bits))
    other, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for j in range(1, n + 1):
        for start, bits in ending[j]:
            other[j] = min(other[j], min(other[start], brute[start]) + _OPEN + bits)
        brute[j] = min(brute[j - 1], min(other[j - 1], brute[j - 1]) + _OPEN) + _char_bits(value[j - 1])
    return min(other[n], brute[n])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed formats; `kind` is the place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def costly_values(text: str, words: dict[str, float], min_bits: float, min_rate: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of the values in credential contexts that cost min_bits or more, and min_rate for each character."""
    for match in _CONTEXT.finditer(text):
        value = match[match.lastgroup]
        if _REFERENCE.fullmatch(value):
            continue
        value = value.rstrip(_CLOSING)
        bits = guess_bits(value, words) if value else 0.0
        if bits >= max(min_bits, min_rate * len(value)):
            start = match.start(match.lastgroup)
            yield start, start + len(value), bits


_loaded: dict[str, dict[str, float]] = {}


def all_spans(text: str, words: dict[str, float], min_bits: float, min_rate: float) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, bits) of a text, sorted."""
    base = base_spans(text)
    edges = sorted((a, b) for a, _, b in base)
    starts, ends = [a for a, _ in edges], np.maximum.accumulate([b for _, b in edges]) if edges else []
    spans = [(a, kind, b, None) for a, kind, b in base]
    for start, end, bits in costly_values(text, words, min_bits, min_rate):
        k = int(np.searchsorted(starts, start, "right"))
        if not k or ends[k - 1] < end:  # else a base span that starts before has it whole
            spans.append((start, len(KINDS) - 1, end, bits))
    return sorted(spans, key=lambda s: s[:3])


def find(docs: DataFrame, words_path: str, min_bits: float = MIN_BITS, min_rate: float = MIN_RATE) -> DataFrame:
    """doc_id and spans (kind, start, end, bits; code points, end exclusive) of every row of docs, by start and then by kind
    as in KINDS.

    assign, access and hex are the fixed formats, leftmost and without overlaps within a kind. guess is a value in the place
    of a credential, without white space, whose guess cost is `min_bits` bits or more and `min_rate` for each character
    (names and phrases put together cost less); references to variables are no values, and what lies in a span of a fixed
    format isn't listed again. bits is null for fixed formats. `words_path` is a tokenizer's json file that every executor
    has (it belongs to an installed package).

    Whole texts are read in one pass without a shuffle; only those that hold a name or a run that can start a span come to
    the patterns. A null text is empty and has no spans. Null ids stay null; repeated rows are told each; other columns are
    ignored. The work for a value grows linearly with its length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if words_path not in _loaded:
            _loaded[words_path] = load_words(words_path)
        words = _loaded[words_path]
        for block in W.blocks(batches, "text"):
            texts = W.column(block, "text")
            likely = pc.or_(pc.or_(pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, "[0-9a-f]{32}")),
                            pc.match_substring_regex(texts, _LIKELY))
            sizes, flat = np.zeros(block.num_rows, np.int64), []
            for i in np.flatnonzero(likely.to_numpy(zero_copy_only=False)).tolist():
                spans = all_spans(texts[i].as_py(), words, min_bits, min_rate)
                sizes[i] = len(spans)
                flat += [{"kind": KINDS[k], "start": a, "end": b, "bits": bits} for a, k, b, bits in spans]
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(at, pa.array(flat, struct))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        read, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, bits: double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    def counted(name: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select("doc_id", *(counted(k) for k in KINDS[:-1]), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), counted(KINDS[-1]))
