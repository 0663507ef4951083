"""Each operator over its whole driver table, by the contract of its query, and equivalent SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundweave.llm import (
    ann_forest, decontamination, hard_negatives, html_extract, language_id, ngram_jaccard, packing, quality, secret_scan,
    spelling_variants, suffix_dedup, token_counts, toxicity, training)

TOKEN_LIMIT = 4096
#: Nothing is learned from rows whose crc32(doc_id as text) mod the first number is the second.
TOXICITY_FOLD, QUALITY_FOLD, LANGUAGE_FOLD = (3, 1), (5, 0), (4, 2)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(_table(spark, sf_dir, "documents"), size=5, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return token_counts.over_limit(counted, TOKEN_LIMIT)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def _scored(scores: DataFrame, fold: tuple[int, int], threshold: float) -> DataFrame:
    return scores.select("doc_id", training.held_out(fold).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"), "toxic", TOXICITY_FOLD)
    return _scored(toxicity.score(documents, model), TOXICITY_FOLD, 0.7)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, _table(spark, sf_dir, "labels"), "quality", QUALITY_FOLD)
    return _scored(quality.score(documents, model), QUALITY_FOLD, 0.3)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return packing.pack_documents(documents, vocabulary("word_bpe_49k.json"), end_id=2, limit=TOKEN_LIMIT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"), length=400)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    predicted = language_id.predict(documents, language_id.fit(documents, LANGUAGE_FOLD))
    return predicted.select("doc_id", training.held_out(LANGUAGE_FOLD).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives; the label of every seventh row is moved on by one first."""
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_ann_forest": op4_ann_forest,
        "op5_html_extract": op5_html_extract,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_language_id": op10_language_id,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_secret_scan": op12_secret_scan,
        "op13_spelling_variants": op13_spelling_variants,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP3_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_OP3_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_OP3_WORD}') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS gram
    FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS r(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
    SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS gram
    FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(k)),
found AS (SELECT DISTINCT doc_id, item, k, size FROM grams JOIN windows USING (size, gram)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(k, k + size)) AS r(p) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_OP1_WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_OP1_WORD}') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS gram
    FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id
    GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reached.doc_id, b FROM reached JOIN links ON a = other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY d.doc_id
"""


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same)
    WHERE place <= 5),
negatives AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
        AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 10
"""


# crc32 byte by byte, with a table made by its rule; variants by the words that are left without one code point.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
    FROM range(256) AS r(b)),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
spelt AS (SELECT run, times, hex(encode(doc_id || ':' || run)) AS digits FROM runs),
hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_transform(range(length(digits) // 2), lambda k: CAST('0x' || digits[2 * k + 1:2 * k + 2] AS BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS h
    FROM spelt, crc),
changed AS (
    SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed),
w AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS rest FROM w, unnest(range(1, length(word) + 1)) AS r(k)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN w b ON a.rest = b.word),
best AS (
    SELECT word, n, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word, n),
forms AS (SELECT word, form, most AS form_n FROM best WHERE most >= 10 * n),
chain AS (SELECT word, form AS root, 1 AS steps FROM forms UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON c.root = f.word),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op3_decontamination": OP3_SQL, "op11_hard_negatives": OP11_SQL,
            "op13_spelling_variants": OP13_SQL}
