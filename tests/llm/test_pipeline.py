"""Each stage of the pipeline against a brute-force version of it, and all stages in a row."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from fundweave.llm import decontamination, quality, suffix_dedup  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed=3, n=60):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "be", "gam", "dél", "Eps", "zet") for b in ("a", "ta", "mo", "né", "ix")]
    long_passage = " ".join(draw.choice(words) for _ in range(120))
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(20, 90))) for _ in range(12)]
    rows = [(0, base[0]), (1, base[1]), (2, base[0] + " more"), (None, base[1]), (None, base[2] + " x"), (None, base[2]), (None, "a b"),
            (3, None), (3, None), (4, ""), (5, " \n "), (1, base[3]), (1, base[3]), (6, "é" * 9000), (7, long_passage), (8, "q " + long_passage)]
    for i in range(20, 20 + n):
        own = draw.choice(base).split(" ")
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((i, " ".join(own) + (" " + long_passage if i % 7 == 0 else "")))
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def table(spark, rows):
    """With further columns that clash with names inside the operators."""
    return spark.createDataFrame([(*r, "k", 1.0, 2) for r in rows], f"{DOCS}, items string, score double, n_words int").repartition(4)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_chars").collect()), key=str)


def as_rows(rows):
    return sorted(((i, t, n) for i, t, _, _, n in rows), key=str)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rows = texts()
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:  # labels spread over links until they stay
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    kept = STAGE["n-gram Jaccard join"](spark, table(spark, rows), "")
    found = rows_of(kept)
    groups = {}
    for k, r in enumerate(rows):
        if sets[k]:
            groups.setdefault(label[k], []).append(r)
    assert len(found) == len(groups) + len({(r[0], r[1]) for k, r in enumerate(rows) if not sets[k]})
    for members in groups.values():
        own = [r for r in found if any((r[0], r[1]) == (m[0], m[1]) for m in members)]
        named = [m[0] for m in members if m[0] is not None]
        assert len(own) == 1 and own[0][0] == (min(named) if named else None)
    assert kept.columns == table(spark, rows).columns


def test_suffix_dedup_takes_out_every_repeated_string(spark):
    rows = [r for r in texts() if r[1] is None or r[1].strip()]
    data = [(r[1] or "").encode() for r in rows]
    count = {}
    for d in data:
        for k in range(len(d) - 399):
            count[d[k:k + 400]] = count.get(d[k:k + 400], 0) + 1
    expected = []
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 399):
            if count[d[k:k + 400]] > 1:
                gone[k:k + 400] = True
        left = bytes(np.frombuffer(d, np.uint8)[~gone]).decode(errors="ignore")
        if not gone.any():
            expected.append(r)
        elif left.strip(" "):
            expected.append((r[0], left, *r[2:4], len(left)))
    cleaned = STAGE["suffix-array dedup"](spark, table(spark, rows), "")
    assert rows_of(cleaned) == as_rows(expected) and len(expected) < len(rows)
    assert cleaned.schema == table(spark, rows).schema
    assert rows_of(suffix_dedup.clean(table(spark, rows).limit(0), 400)) == []


def brute_contaminated(text, items, window=13, share=20):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit = [False] * len(words)
    for item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        for k in range(len(own) - min(window, len(own)) + 1):
            w = own[k:k + window]
            for j in range(len(words) - len(w) + 1):
                if w and words[j:j + len(w)] == w:
                    hit[j:j + len(w)] = [True] * len(w)
    return sum(hit) > 0 and share * sum(hit) >= len(words)


@pytest.mark.parametrize("block_words", [50_000, 15])
def test_decontamination_drops_what_holds_benchmark_text(spark, block_words):
    rows = texts()
    items = [rows[20][1][10:200], rows[30][1], "a b", None, "", rows[7][1]]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = decontamination.keep_clean(table(spark, rows), benchmark, block_words=block_words)
    expected = [r for r in rows if not brute_contaminated(r[1], items)]
    assert rows_of(kept) == as_rows(expected) and 5 < len(expected) < len(rows)
    assert kept.schema == table(spark, rows).schema
    assert rows_of(decontamination.keep_clean(table(spark, rows), benchmark.limit(0))) == as_rows(rows)
    assert rows_of(decontamination.keep_clean(table(spark, rows).limit(0), benchmark)) == []


def test_quality_keeps_what_its_scores_say(spark):
    draw = np.random.default_rng(2)
    model = quality.Model(np.array([0.1], np.float32), draw.normal(size=quality.BUCKETS + len(quality.STATISTICS)).astype(np.float32),
                          draw.normal(0, 0.3, (quality.BUCKETS + len(quality.STATISTICS), 4)).astype(np.float32),
                          np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    docs = table(spark, texts())
    scores = quality.score(docs.withColumn("doc_id", F.struct("doc_id", F.coalesce("text", F.lit("null")))), model).collect()
    expected = sorted(str(tuple(r["doc_id"])) for r in scores if r["score"] >= 0.3)
    kept = quality.keep(docs, model, 0.3)
    assert sorted(str((r["doc_id"], "null" if r["text"] is None else r["text"])) for r in kept.collect()) == expected
    assert kept.schema == docs.schema and 0 < len(expected) < len(scores)
    assert quality.keep(docs.limit(0), model, 0.3).collect() == []
    assert quality.keep(docs.drop("n_chars"), model, -1.0).count() == docs.count()


def test_the_run_is_its_stages_in_a_row(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert docs.columns == columns
        docs = stage(spark, docs, sf_dir)
    done = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, done.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))
    assert done.count() > 0
