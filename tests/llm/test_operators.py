"""The ten operators against brute force, their libraries, exact round trips or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundweave.llm import (
    ann_forest, decontamination, html_extract, language_id, ngram_jaccard, packing, quality, suffix_dedup, token_counts,
    toxicity, training)

vocabularies = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


def rows_of(df, order="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_documents(seed=0, n=40):
    """Nulls, empty and very long texts, repeated rows, copies, near copies, shared passages."""
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "ε", "zeta", "Eta", "theta", "iota's", "kappa!", "x", "yy", "12"]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, base[0]), (4, base[0]), (4, base[0]), (5, "one two"), (6, "One two"),
            (7, "word " * 3000), (8, "e" * 20000), (None, None)]
    for i in range(20, 20 + n):
        own = draw.choice(base).split(" ")
        for _ in range(draw.randint(0, 2)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((i, " ".join(own) + draw.choice(["", " ", "\n" + draw.choice(base)])))
    return rows


def with_extra(spark, rows):
    """Columns that clash with names of results."""
    return spark.createDataFrame([(*r, "k", 1, 2.0) for r in rows], f"{DOCS}, key string, n long, score double")


# ---------------------------------------------------------------- 1
def brute_components(rows, size=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_join(spark, seed):
    rows = odd_documents(seed)
    assert rows_of(ngram_jaccard.join(with_extra(spark, rows))) == brute_components(rows)


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    draw = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(draw.randint(0, 4)):
            own[draw.randrange(120)] = f"v{draw.randrange(50)}"
        rows.append((i, " ".join(own)))
    assert rows_of(ngram_jaccard.join(spark.createDataFrame(rows, DOCS))) == brute_components(rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    assert {r["key"]: r["label"] for r in ngram_jaccard.components(links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# ---------------------------------------------------------------- 2
ODD_TEXTS = ["a  b", " a", "a ", "a ▁b", "a▁ b", "", "\t x", "é b", "a ́b", " " * 50 + "x", "“x” y", "<s> </s> a", "a\x00b c", "漢字 かな 🎉 x🎉y", None,
             "word " * 4000, "don't  stop "]


def test_token_counts_are_the_librarys(spark):
    import sentencepiece

    path = vocabularies.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*enumerate(ODD_TEXTS), (3, "again"), (3, "again"), (None, "no id")]
    found = token_counts.over_limit(token_counts.count_tokens(with_extra(spark, rows), path), 100)
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in rows]
    assert rows_of(found) == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


# ---------------------------------------------------------------- 3
def brute_overlaps(rows, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for doc_id, text in rows:
        w, hit, got = split(text), set(), set()
        for item, t in items:
            own = split(t)
            size = min(len(own), window)
            windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)} if size else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    got.add(str(item))
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("block_words", [50_000, 20])
def test_overlaps_with_a_benchmark(spark, block_words):
    rows = odd_documents(5)
    draw = random.Random(7)
    texts = [t for _, t in rows if t]
    items = [(i, " ".join(draw.choice(texts).split()[:draw.randint(1, 9)])) for i in range(12)] + [(99, None), (98, ""), (3, "yy x"), (3, "yy x")]
    found = decontamination.find_overlaps(with_extra(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 5, block_words)
    assert rows_of(decontamination.digest(found)) == brute_overlaps(rows, items, 5)


def test_spans_are_taken_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. The quick brown fox, jumps over it. " + "and other words " * 60), (2, "the quick brown fox jumps"), (3, "clean")], DOCS)
    items = spark.createDataFrame([(1, "the quick brown fox jumps over")], "item_id long, text string")
    out = dict(tuple(r) for r in decontamination.without_spans(docs, items, window=3, longest_span=3).collect())
    assert out == {1: "Keep this.  it. " + "and other words " * 60, 3: "clean"}


# ---------------------------------------------------------------- 4
def test_neighbours_reach_the_recall_and_are_exact(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 16)) * draw.uniform(0.5, 2, (3000, 1))
    x[1000:2000] = x[1000]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [1.0]), (None, [1.0] * 16), (5004, [None] + [1.0] * 15), (5, rows[5][1])]
    from pyspark.sql import functions as F
    found = ann_forest.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=10)
    hit = total = 0
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == set(range(0, 3000, 20))
    for query, got in by_query.items():
        got.sort(key=lambda r: r["rank"])
        scores = (x * x[query]).sum(axis=1)
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert all(r["vec_id"] != query and abs(r["score"] - scores[r["vec_id"]]) < 1e-12 for r in got)
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        others = [i for i in range(3000) if i != query]
        true = sorted(others, key=lambda i: (-scores[i], i))[:10]
        hit, total = hit + len({*true} & {r["vec_id"] for r in got}), total + 10
    assert hit >= 0.9 * total


def test_neighbours_of_repeated_rows_and_ids(spark):
    from pyspark.sql import functions as F
    draw = np.random.default_rng(4)
    x = draw.normal(size=(900, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2  # each row twice
    rows += [(1, x[1].tolist())] * 28  # and one thirty times
    rows += [(3, (x[0] * (2 + k / 100)).tolist()) for k in range(40)]  # an id of many near vectors
    found = ann_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 1, 100, 200, 300), k=20)
    best = {}
    for query in (0, 1, 100, 200, 300):
        for i, v in rows:
            if i != query:
                score = float((np.array(v) * x[query]).sum())
                best[query, i] = max(best.get((query, i), score), score)
    true = {(q, i) for q in (0, 1, 100, 200, 300) for i in sorted((i for p, i in best if p == q), key=lambda i: (-best[q, i], i))[:20]}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found.collect()}
    assert set(got) == true and all(abs(got[pair] - best[pair]) < 1e-12 for pair in got)


def test_neighbours_of_few_and_no_rows(spark):
    from pyspark.sql import functions as F
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = ann_forest.search(few, F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert ann_forest.search(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# ---------------------------------------------------------------- 5
STORY = "First paragraph of the story, with commas, and enough length to be scored well."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<div>" * 2000 + STORY, STORY),
    (f"<body><div id=header><p>{STORY}</p></div><div class='content'><h1>Title</h1><p>{STORY}</p><p>A <b>bo</b>ld &amp; <a href=x>linked</a>&nbsp;end, for now.</p>"
     f"<div class='ad-box'>Buy</div></div><div id='comments'><p>{STORY}</p></div><aside>{STORY}</aside><footer>{STORY}</footer>",
     f"Title {STORY} A bold & linked end, for now."),
    (f"<main><p>{STORY}</p><form><p>Your mail</p></form></main><script>if(a<b){{x='</p>'}}</script><style>p{{}}</style>", STORY),
    (f"<article><p>{STORY}<br>Next\n line</p></article><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> -->", f"{STORY} Next line"),
    (f"<body><div class='cookie-notice'>{STORY}</div><div class='post'><p>{STORY}</p><p>{STORY}</p><ul class='related'><li><a>x</a></ul></div>", f"{STORY} {STORY}"),
])
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


LONG = " ".join([STORY] * 3)


@pytest.mark.parametrize(("html", "text"), [
    (f"<body><div class='content-sidebar-wrap'><main><article><p>{STORY}</p></article></main><div class='sidebar'><p>{STORY}</p></div></div></body>", STORY),
    (f"<body><div class='main-content has-sidebar'><p>{STORY}</p><p>{LONG}</p></div><div class='sidebar'><p>{STORY}</p></div></body>", f"{STORY} {LONG}"),
    (f"<body><div id='content' class='no-sidebar'><h1>Title</h1><p>{STORY}</p></div></body>", f"Title {STORY}"),
    (f"<body><div class='has-sidebar'><article><p>{STORY}</p></article></div><p>Imprint</p></body>", STORY),
    (f"<body><div class='has-sidebar'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'>Ad</div><p>Imprint</p></body>", f"{LONG} {LONG}"),
    (f"<body><div class='has-sidebar'><p>{STORY}</p><p>{STORY}</p></div><p>Imprint</p></body>", f"{STORY} {STORY}"),
    (f"<div id='page' class='comments-open'><article class='post has-comments'><p>{STORY}</p></article><ol class='comments'><li class='comment'>"
     f"<article class='comment-body'><p>{LONG}</p></article></ol></div>", STORY),
    (f"<div class='comments'><p>{STORY}</p></div>", STORY),
    (f"<div class='ad'><p>{LONG}</p></div><article><h1>Title</h1><p>Short.</p></article>", "Title Short."),
    (f"<article><h1>Title</h1><div class='widget-container'><p>{LONG}</p></div></article>", f"Title {LONG}"),
    (f"<article><p>{LONG}</p><div class='related'><article><p>Other</p></article></div></article>", LONG),
])
def test_names_alone_take_no_article_away(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("menu", [
    "<nav><ul>" + "<li><a href=/>Home</a>" * 1000 + "</ul></nav>",
    "<form><select>" + "<option>Country" * 1000 + "</select></form>",
    "<nav>" + "<p>Home" * 1000 + "</nav>",
    "<nav>" + "<span>Home" * 1000 + "</nav>",
    "<nav><table>" + "<tr><td>Home" * 1000 + "</table></nav>",
    "<ul><li hidden>Home<li hidden>Away</ul>",
    "<p hidden>Home",
])
def test_unclosed_elements_inside_unwanted_ones(menu):
    assert html_extract.main_text(f"<body>{menu}<article><p>{STORY}</p></article></body>") == STORY


def test_unclosed_unwanted_elements_take_linear_time():
    for html in ("<nav>" + "<span>" * 200_000 + "</i>" * 200_000, "<nav>" + "<li>" * 200_000 + "</nav>", "<nav>" + "<b></i>" * 100_000,
                 "<div class=ad>" * 20_000, "<div class=ad><article>" * 20_000):
        html_extract.main_text(html)


DIGEST = "".join(f"<li><a href=/{k}>Report {k} of the committee on the harbour</a></li>" for k in range(30))
TERMS = "".join(f"<li><a href=/{k}>Term {k}</a></li>" for k in range(60))
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/b>Blog</a></li></ul>"


def words_of(html):
    return " ".join(re.sub("<[^>]*>", " ", html).split())


@pytest.mark.parametrize(("html", "text"), [
    (f"<article><p>{LONG}</p><ul>{DIGEST}</ul></article>", f"{LONG} {words_of(DIGEST)}"),
    (f"<article><p>{LONG}</p><ol>{TERMS}</ol></article>", f"{LONG} {words_of(TERMS)}"),
    (f"<article><h1>Links</h1><ul>{DIGEST}</ul></article>", f"Links {words_of(DIGEST)}"),
    (f"<div class='post'><a href=/><p>{STORY}</p><p>{LONG}</p></a></div>", f"{STORY} {LONG}"),
    (f"<section><p><a href=/>{STORY}</a></p></section>", STORY),
    (f"<article><p>{LONG}</p><ol><li><a href=/>A paper</a>, 2010, pages 1 to 9</li><li><a href=/>Another paper on it</a></li></ol></article>",
     f"{LONG} A paper, 2010, pages 1 to 9 Another paper on it"),
    (f"<article>{MENU}<h1>Title</h1><p>{LONG}</p>{MENU}</article>", f"Title {LONG}"),
    (f"<article><p>{LONG}</p>{MENU}<p>{LONG}</p></article>", f"{LONG} {words_of(MENU)} {LONG}"),
])
def test_linked_text_of_an_article_stays(html, text):
    assert html_extract.main_text(html) == text


SECTION = f"<section><h2>A</h2><p>{LONG}</p><p>{LONG}</p></section>"
A = f"A {LONG} {LONG}"


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize(("before", "after", "text"), [
    ("<p>Short intro.</p>", "", f"Short intro. {A}"),
    ("", "<section><h2>B</h2><p>Closing words.</p></section>", f"{A} B Closing words."),
    ("", "<div>The end.</div>", f"{A} The end."),
    ("<ul><li>One</li><li>Two</li></ul>", "", f"One Two {A}"),
    ("", "<table><tr><td>1</td><td>2</td></tr></table>", f"{A} 1 2"),
    ("<figure><img src=x><figcaption>A view</figcaption></figure>", "", f"A view {A}"),
    ("Loose text", "more of it", f"Loose text {A} more of it"),
    ("", f"<div><div><p>{STORY}</p></div></div>", f"{A} {STORY}"),
    ("<p><a href=/>One link</a></p>", "", f"One link {A}"),
])
def test_short_parts_of_an_article_stay(around, before, after, text):
    page = f"<body><div>Site</div><div class='w'><{around}>{before}{SECTION}{after}</{around}></div><div class='sidebar'><p>{LONG}</p></div><div>Imprint</div></body>"
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(("inner", "text"), [
    (f"<p>Short intro.</p>{SECTION}<div>The end.</div>", f"Short intro. {A} The end."),
    (f"<div>{SECTION}</div><div><p>{LONG}</p></div>", f"{A} {LONG}"),
    (f"<div><div>{SECTION}</div></div><h2>B</h2><p>So it was.</p><div><div><p>{LONG}</p></div></div>", f"{A} B So it was. {LONG}"),
    (f"<div>{SECTION}</div><div><a href=/>Elsewhere</a></div>", A),
])
def test_short_parts_stay_on_pages_without_article(inner, text):
    assert html_extract.main_text(f"<body><div>Site</div><div>{inner}</div><div>Imprint</div></body>") == text


def test_odd_markup_takes_linear_time():
    for html in ("<" * 200_000, "<a " * 100_000, '<div class="' * 50_000, "</p>" * 100_000, "<!-- " * 100_000, "<b><p>" * 20_000,
                 f"<div>a<p>{STORY}</p>" * 10_000):
        html_extract.main_text(html)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{STORY}</p>", "x"), (1, "u", f"<p>{STORY}</p>", "y"), (None, None, None, None)],
                                  "page_id long, url string, html string, text string")
    assert rows_of(html_extract.extract(pages)) == [(1, "u", STORY, len(STORY)), (1, "u", STORY, len(STORY)), (None, None, "", 0)]


# ---------------------------------------------------------------- 6, 7, 10
def labelled(n=900, seed=2):
    draw = random.Random(seed)
    good = ["river", "mountain", "window", "garden", "letter", "morning", "paper", "silver", "winter", "travel"]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(good) + draw.choice(["", "s", "ed"]) for _ in range(draw.randint(30, 200))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for k in range(0, len(words), 30):
                words[k] = draw.choice(["rotten", "rott3n", "rottenest", "vilest", "vile"])
        text = " ".join(words[1:2] * len(words)) if poor else " ".join(words)
        docs.append((i, text, None))
        labels.append((i, int(not poor), int(toxic and not poor)))
    return docs, labels


def accuracy(scores, labels, column, threshold, fold):
    kept = [(r["score"] >= threshold) == bool(labels[r["doc_id"]][column]) for r in scores if zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]]
    return sum(kept) / len(kept)


@pytest.mark.parametrize(("operator", "label", "column", "fold", "threshold"), [
    (toxicity, "toxic", 2, (3, 1), 0.7), (quality, "quality", 1, (5, 0), 0.3)])
def test_classifiers_on_held_out_rows(spark, operator, label, column, fold, threshold):
    docs, labels = labelled()
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = operator.fit(table, known, label, fold)
    by_id = {r[0]: r for r in labels}
    assert accuracy(operator.score(table, model).collect(), by_id, column, threshold, fold) > 0.95
    odd = spark.createDataFrame([(1, None, None, "a"), (None, "", 3, "b"), (1, "word " * 5000, -1, "c")], "doc_id long, text string, n_chars long, score string")
    assert all(0 <= r["score"] <= 1 for r in operator.score(odd, model).collect())
    nothing = operator.fit(table, known.limit(0), label, fold)
    assert {r["score"] for r in operator.score(odd, nothing).collect()} == {0.5}
    assert operator.score(table.limit(0), model).collect() == []


@pytest.mark.parametrize("buckets", [toxicity.BAG_BUCKETS, 20_000])
def test_toxicity_is_learned_from_long_texts(spark, buckets):
    docs, labels = labelled(300)
    docs = [(i, (text + " ") * (8000 // len(text) + 1), lang) if labels[i][2] else (i, text, lang) for i, text, lang in docs]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", (3, 1), buckets=buckets)
    found = toxicity.score(table, model).collect()
    assert accuracy(found, {i: (q, t) for i, q, t in labels}, 1, 0.5, (3, 1)) > 0.9


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = labelled(200)
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    turned = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels]
    a, b = (quality.fit(table, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), "quality", (5, 0), rounds=5) for x in (labels, turned))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.weight, b.weight)


def test_sum_of_squares_is_all_pairs():
    draw = np.random.default_rng(0)
    x, v = draw.normal(size=(1, 6)), draw.normal(size=(6, 3))
    pairs = sum(x[0, i] * x[0, j] * (v[i] @ v[j]) for i in range(6) for j in range(i))
    assert quality._interactions(x @ v, (x * x) @ (v**2).sum(axis=1))[0] == pytest.approx(pairs)


def test_languages_on_held_out_rows(spark):
    draw = random.Random(1)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schl", "ung", "eit", "er"], "cc": ["ção", "lh", "ões", "em"]}
    docs = []
    for i in range(600):
        lang = draw.choice(list(parts))
        docs.append((i, " ".join("".join(draw.choice(parts[lang]) for _ in range(3)) for _ in range(draw.randint(10, 200))), lang))
    table = spark.createDataFrame([*docs, (700, None, "aa"), (701, "123 456", "aa"), (None, "kato mira", None)], "doc_id long, text string, lang string")
    net = language_id.fit(table, (4, 2), steps=200)
    found = {r["doc_id"]: r for r in language_id.predict(table, net).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert (found[700]["lang_pred"], found[701]["lang_pred"]) == ("und", "und")
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.fit(table.limit(0), (4, 2)) is None
    assert {r["lang_pred"] for r in language_id.predict(table, None).collect()} == {"und"}


def test_sample_is_bounded_and_balanced(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, y int")
    picked, totals = training.sample(labels, "y", ~training.held_out((3, 1)), 100, 2)
    rows = picked.collect()
    assert Counter(r["label"] for r in rows) == {0: 50, 1: 50} and sum(totals.values()) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(1000))
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows)


# ---------------------------------------------------------------- 8
PACK_TEXTS = ["a  b", "", None, "don't STOP it's 'tis x'S 'ſ", "é Éa á", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "a\x01b \x01 c", "12ab!!'s't ...''t",
              "漢字 かな 🎉 x🎉y", "\x0b\x0ca\x1cb\x85c", "İI Σσς ΑΣ", "_a_b__c a-b", "́a ́", "ﬁ ½ x²", "word, " * 5000, "again", "again"]


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    path = vocabularies.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = with_extra(spark, [*enumerate(PACK_TEXTS), (None, "no id")])
    found = packing.pack(packing.pieces(docs, path, limit=64, keep_ids=True), 64).collect()
    ids = {}
    for r in found:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        ids.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
    for doc_id, text in [*enumerate(PACK_TEXTS), (None, "no id")]:
        whole = [x for start, part, _ in sorted(ids[doc_id]) for x in part]
        assert whole == [*library.encode(text or "", add_special_tokens=False).ids, 2] and ids[doc_id][0][2] == len(whole)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs.limit(0), path).collect() == []


def test_patterns_hold_every_piece_and_stay_few():
    draw = random.Random(5)
    counts = Counter(min(int(draw.expovariate(1 / 300)) + 1, 4096) for _ in range(50_000))
    patterns = packing.pack_histogram(dict(counts), 4096)
    packed = Counter()
    for count, made in patterns:
        assert sum(length * times for length, times in made) <= 4096
        for length, times in made:
            packed[length] += count * times
    assert packed == counts and len(patterns) <= 4096
    assert sum(length * n for length, n in counts.items()) >= 0.96 * 4096 * sum(count for count, _ in patterns)


# ---------------------------------------------------------------- 9
def brute_repeats(rows, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                mark[k:k + length] = b"\1" * length
        runs = sum(bool(m) and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        out.append((i, len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize(("seed", "length"), [(0, 8), (1, 21), (2, 60)])
def test_repeated_strings_go(spark, seed, length):
    rows = [*odd_documents(seed, 25), (300, "ab" * 40), (301, "x" * 70 + "end"), (302, "start" + "x" * 70)]
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in rows]
    assert rows_of(suffix_dedup.digest(with_extra(spark, rows), length)) == brute_repeats(rows, length)


def test_repeated_strings_of_no_rows(spark):
    assert suffix_dedup.digest(spark.createDataFrame([], DOCS)).collect() == []
    assert ngram_jaccard.join(spark.createDataFrame([], DOCS)).collect() == []


def test_cleaned_texts_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "abcdefgh unique", "a"), (2, "other abcdefgh", "b"), (3, None, "c")], "doc_id long, text string, key string")
    assert rows_of(suffix_dedup.clean(docs, 8)) == [(1, " unique", "a"), (2, "other ", "b"), (3, None, "c")]


# ---------------------------------------------------------------- types, few labels, many classes
def test_ids_and_labels_of_other_types_are_learned_from(spark):
    texts = ["kind words of praise " * 3, "x9 zz qq junk " * 4]
    docs = spark.createDataFrame([(f"doc {i}", texts[i % 2] + str(i)) for i in range(120)], "doc_id string, text string")
    for kind in ("long", "boolean", "string"):
        labels = docs.select("doc_id", (F.split("doc_id", " ")[1].cast("int") % 2).cast(kind if kind != "boolean" else "boolean").alias("quality"))
        if kind == "string":
            labels = labels.withColumn("quality", F.col("quality").cast("int").cast("string"))
        labels = labels.unionAll(labels.withColumn("doc_id", F.concat(F.lit("gone "), "doc_id")))
        for module in (quality, toxicity):
            model = module.fit(docs, labels, "quality", (5, 0))
            found = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
            assert all((score > 0.5) == (int(name.split(" ")[1]) % 2 == 1) for name, score in found.items()), (module, kind)


def test_every_language_is_learned(spark):
    rows = [(f"d{i}", f"{chr(0x100 + i % 210) * 40}", f"l{i % 210:03}") for i in range(840)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id string, text string, lang string"), (4, 2), steps=2)
    assert len(net.languages) == 210


def test_words_of_few_toxic_texts_are_learned(spark):
    rows = [(i, f"plain text number {i} about many things") for i in range(1500)] + [(2000 + i, "vile slur here") for i in range(13)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") >= 2000).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, "toxic", (3, 1))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert min(s for i, s in scores.items() if i >= 2000) > 0.7 > 0.5 > max(s for i, s in scores.items() if i < 2000)


def test_long_vectors_at_right_angles_are_ranked_exactly():
    draw = np.random.default_rng(1)
    query = draw.normal(size=64)
    rows = draw.normal(size=(400, 64))
    rows -= (rows @ query / (query @ query))[:, None] * query
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True) * 5e8 + query * draw.normal(size=(400, 1)) * 1e-9
    found = ann_forest.best(np.arange(400), rows, np.array([-1]), query[None], 20)[0]
    exact = (rows * query).sum(axis=1)
    assert found[1].tolist() == sorted(range(400), key=lambda i: (-exact[i], i))[:20]


def test_removed_strings_of_400_bytes_are_those_of_brute_force(spark):
    """Documents of the driver's table, every string of 400 bytes."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(hash(data[k:k + 400]) for k in range(len(data) - 399))
    found = {r["doc_id"]: r for r in suffix_dedup.digest(spark.createDataFrame(rows, DOCS), 400).collect()}
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 399):
            if seen[hash(data[k:k + 400])] > 1:
                gone[k:k + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == (len(data), int(gone.sum()), runs, kept)


def test_packing_tokenises_in_small_blocks():
    """Two workers of an executor hold these arrays next to its heap."""
    import tracemalloc

    import pyarrow as pa

    from fundweave.llm import packing, words as W
    from fundweave.llm.queries import vocabulary

    path = vocabulary("word_bpe_49k.json")
    texts = pa.record_batch({"text": [" ".join(f"word{(7 * i + k) % 500}" for k in range(300)) for i in range(2_000)]})
    packing.token_ids(*W.raw(W.column(texts.slice(0, 1), "text")), path)  # the tokenizer itself
    W._powers.clear()
    tracemalloc.start()
    try:
        for block in W.blocks(iter([texts]), "text", packing.BLOCK_BYTES):
            packing.token_ids(*W.raw(W.column(block, "text")), path)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 24e6, peak
