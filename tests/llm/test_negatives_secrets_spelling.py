"""Hard negatives, secret scans and spelling variants against brute force, and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundweave.llm import hard_negatives, secret_scan, spelling_variants

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- 11
def brute_negatives(rows, every, positives=5, negatives=10, low=30, high=90):
    usable = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows
              if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, own == label) for j, own, w in usable if j != i)
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def vector_rows(seed, n=400, dim=6, labels=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dim))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + draw.normal(size=dim) * 0.4], int(draw.integers(labels))) for i in range(n)]
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(60)]  # one vector very often: ties
    rows += [rows[10], rows[10], rows[20], (2000, None, 1), (2001, [1.0, None] * 3, 1), (2002, [math.nan] * dim, 1), (2010, [0.0] * dim, 1),
             (2003, [math.inf] * dim, 0), (2004, [1.0] * dim, None), (None, [1.0] * dim, 1), (2005, [], 1), (2020, [0.0] * dim, 0)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"block_rows": 1, "clusters": 3}), (2, {"clusters": 1, "sample": 2})])
def test_hard_negatives_equal_brute_force(spark, seed, options, monkeypatch):
    monkeypatch.setattr(hard_negatives, "MEMBERS", 4)
    rows = vector_rows(seed)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    df = df.withColumns({"id": F.lit("x"), "a": F.lit(1), "rank": F.lit(2.0), "cluster": F.lit(None)})
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options)
    expected = brute_negatives(rows, 10)
    assert rows_of(found) == expected and len(expected) > 500


def test_hard_negatives_of_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], VECTORS)
    assert rows_of(hard_negatives.mine(one, F.col("vec_id") % 10 == 0)) == []
    assert rows_of(hard_negatives.mine(one.limit(0), F.col("vec_id") % 10 == 0)) == []
    assert rows_of(hard_negatives.mine(one, F.lit(None).cast("boolean"))) == []
    two = one.unionAll(spark.createDataFrame([(2, [0.5, 1.0], 2), (3, [-1.0, -1.0], 2)], VECTORS))
    assert rows_of(hard_negatives.mine(two, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 5 * 256 * 256, 5 * 256 * 128)]


def test_hard_negatives_take_labels_of_text_and_large_numbers(spark):
    rows = [(i, [float(x) * 1e4 for x in v], label) for i, v, label in vector_rows(5, n=80)[:80]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    named = df.withColumn("label", F.concat(F.lit("kind "), "label"))
    assert rows_of(hard_negatives.mine(named, F.col("vec_id") % 10 == 0)) == brute_negatives(rows, 10)
    large = [(i, [x * 1e2 for x in v], label) for i, v, label in rows]  # beyond exact products of doubles
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")
    assert rows_of(hard_negatives.mine(df, F.col("vec_id") % 10 == 0)) == brute_negatives(large, 10)


# ---------------------------------------------------------------- 12
def brute_base(text):
    text = text or ""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
    found = []
    for kind, (name, pattern) in enumerate((("assign", assign), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        at = 0
        while match := pattern.search(text, at):
            at = match.end()
            if (kind == 0 and len(match[2]) >= 8) or (kind == 1 and len(match[0]) >= 16) or (kind == 2 and len(match[0]) >= 32):
                found.append((match.start(), kind, match.end(), name))
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


def secret_texts():
    draw = random.Random(4)
    alphabet = ["token", "SECRET", "Password", "api_key", "apikey", "passwd", ":", "=", " ", "  ", '"', "'", "abc", "0123456789abcdef" * 2,
                "AKIA", "AKIA" + "Z9" * 8, "é", "ſ", "x" * 9, "==", "\n", "pwd: ", "kJ8sd7Fh2LqpW0zX", "Tr0ub4dor&3zQ!", "Bearer ", "a/b+c.d-e_f=g"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 25))) for _ in range(400)]
    return [None, "", " ", "word " * 30000 + "token=abcdefgh", "paſſword=abcdefghi", "token: token:abcdefgh", *texts, "ab" * 50000, "é" * 9 + "token = 'ZZZZZZZZ1'"]


def test_fixed_formats_equal_brute_force(spark):
    texts = secret_texts()
    rows = [*enumerate(texts), (None, "token=abcdefgh"), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kind string, n_hex int").repartition(4)
    found = secret_scan.find(df, VOCABULARY)
    base = found.select("doc_id", F.transform(F.filter("spans", lambda s: s["kind"] != "guess"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])).alias("b"))
    expected = sorted(((i, tuple(brute_base(text))) for i, text in rows), key=str)
    assert sorted(((r["doc_id"], tuple(r["b"])) for r in base.collect()), key=str) == expected
    assert sum(len(b) for _, b in expected) > 200
    digest = {r["doc_id"]: r for r in secret_scan.digest(found).collect()}
    for i, text in enumerate(texts):
        own, r = brute_base(text), digest[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in own) for k in ("assign:", "access:", "hex:"))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("guess")] == own


def brute_bits(value, words):
    """The least over all segmentations, by trying every cut and for each part every kind."""
    spans = {}
    for a, b, _, bits in secret_scan.spans_of(value, words):
        spans[a, b] = min(bits, spans.get((a, b), math.inf))

    @cache
    def least(at, was_brute):
        if at == len(value):
            return 0.0
        out = []
        for end in range(at + 1, len(value) + 1):
            if (at, end) in spans:
                out.append(math.log2(5) + spans[at, end] + least(end, False))
            if not was_brute:
                cost = sum(math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33) if c.isascii() else math.log2(100) for c in value[at:end])
                out.append(math.log2(5) + cost + least(end, True))
        return min(out, default=math.inf)

    return least(0, False)


def test_guess_cost_is_the_least_over_all_segmentations():
    words = secret_scan.load_words(VOCABULARY)
    draw = random.Random(9)
    parts = ["password", "qwer", "1987", "abab", "aaaa", "x9$", "19.05.87", "20240131", "Zß", "4dm1n", "poiuy", "7"]
    for _ in range(150):
        value = "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))[:18]
        assert secret_scan.guess_bits(value, words) == pytest.approx(brute_bits(value, words))
    kinds = {(value[a:b], kind) for value in ("19.05.1987", "qwertyuiop", "abcabcabc", "p4ssw0rd", "31/12/2001")
             for a, b, kind, _ in secret_scan.spans_of(value, words)}
    assert {("19.05.1987", "date"), ("qwertyuiop", "walk"), ("abcabcabc", "repeat"), ("p4ssw0rd", "word"), ("31/12/2001", "date")} <= kinds


def test_cheap_values_cost_less_than_random_ones_and_are_left_alone():
    words = secret_scan.load_words(VOCABULARY)
    cheap = ["password123", "Qwertyuiop", "aaaaaaaaaaaaaaaa", "summer2024!", "letmein1", "19.05.1987", "abcdefghij", "P@ssw0rd!"]
    dear = ["xK9#mQ2$vL7p", "kJ8sd7Fh2LqpW0zX", "Tr0ub4dor&3zQ", "b44e15e09fd311c3cf3163b66d5a9875"]
    assert max(secret_scan.guess_bits(v, words) for v in cheap) < 35 < 45 < min(secret_scan.guess_bits(v, words) for v in dear)
    found = lambda text: [text[a:b] for a, k, b, _ in secret_scan.all_spans(text, words, 40.0, 3.5) if k == 3]
    for value in cheap:
        assert found(f"pwd: {value}") == []
    for value in dear[:3]:  # the last one is a span of the fixed formats
        for text in (f"pwd='{value}', next", f"see x://me:{value}@host/", f"Private-Key := {value}."):
            assert found(text) == [value], text
    assert found(f"Authorization: Bearer {dear[1]}.") == [dear[1]]
    for text in ("the secret is out", "pwd = ${DATABASE_PASSWORD_FILE}", "token: process.env.SECRET_TOKEN_NAME", "auth: <your own key here>",
                 "compass: xK9#mQ2$vL7p", "xK9#mQ2$vL7p kJ8sd7Fh2LqpW0zX", "pass: https://example.com/kJ8sd7Fh2LqpW0zX"):
        assert found(text) == [], text


def test_long_values_take_linear_time():
    words = secret_scan.load_words(VOCABULARY)
    assert secret_scan.guess_bits("ab1x" * 4000, words) < 60
    assert secret_scan.guess_bits("a" * 20000, words) < 30


# ---------------------------------------------------------------- 13
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(rows, one_in=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out, form = [], {}
    for w in n:
        best = min((v for v in n if near(w, v)), key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], sum(near(w, v) for v in n), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelling_rows(seed=0):
    draw = random.Random(seed)
    base = ["government", "Épreuves", "çağrıları", "straßen", "aaaaaaaa", "language", "abababab", "ÿÀÿÀÿÀÿÀ", "z" * 700, "×÷×÷×÷×÷"]
    words = []
    for word in base:
        words += [word] * draw.choice([1, 12, 130])
        for _ in range(12):
            w = list(word)
            for _ in range(draw.randint(1, 2)):
                k = draw.randrange(len(w))
                w[k:k + draw.randint(0, 1)] = draw.choice(["", "a", "b", "é"])
            words += ["".join(w)] * draw.choice([1, 2, 13])
    draw.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return [*rows, rows[3], (3, rows[3][1].upper()), (None, rows[5][1]), (None, None), (50, None), (51, ""), (52, "short words only"),
            (53, "language-language_LANGUAGE\u0100language"), (54, "été" * 3000)]


@pytest.mark.parametrize(("one_in", "block_words"), [(31, 1024), (2, 3)])
def test_variants_equal_brute_force(spark, one_in, block_words, monkeypatch):
    monkeypatch.setattr(spelling_variants, "_TEXT_BYTES", 500)
    monkeypatch.setattr(spelling_variants, "_CELLS", 1 << 12)
    rows = spelling_rows(one_in)
    df = spark.createDataFrame([(*r, "w", 5) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    words = spelling_variants.count_words(df, one_in=one_in)
    whole = spelling_variants.group(words)
    expected = brute_variants(rows, one_in)
    assert rows_of(whole) == expected and sum(r[4] > 0 for r in expected) > 40 and sum(r[1] is not None for r in expected) > 5
    pairs = {tuple(sorted((r["word"], r["other"]))) for r in spelling_variants.near_pairs(words, block_words=block_words).collect()}
    every = [r[0] for r in expected]
    assert pairs == {(a, b) for a in every for b in every if a < b and near(a, b)}


def test_chains_are_followed_to_their_end_and_pairs_come_once(spark):
    chain = [("a" * 7 + "b" * k, 11 ** k) for k in range(9)]
    words = spark.createDataFrame([*chain, ("unlike words", 5)], "word string, n long")
    found = {r["word"]: r for r in spelling_variants.group(words).collect()}
    assert {r["root"] for w, r in found.items() if w != "unlike words"} == {chain[-1][0]}
    assert found["unlike words"]["root"] == "unlike words" and found["unlike words"]["n_near"] == 0
    pairs = spelling_variants.near_pairs(words).collect()
    assert len(pairs) == 8


def test_no_words_give_no_rows(spark):
    none = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling_variants.variants(none).collect() == []
    assert spelling_variants.variants(none.limit(0)).collect() == []
