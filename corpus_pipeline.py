"""A training corpus from raw documents: reject poor ones, keep one of each group of near copies, take out repeated
passages, drop benchmark leaks, and pack what is left into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundweave.llm import decontamination, ngram_jaccard, packing, quality, shared, suffix_dedup
from fundweave.llm.queries import QUALITY_FOLD, TOKEN_LIMIT, vocabulary

#: No SQL: the first stage's model and the third's bytes can't be expressed there. tests/llm/test_pipeline.py
#: compares each stage with a brute-force version.
ORACLE_SQL = None


def _row() -> Column:
    """What a row is known by: id and text. Rows without id come after all others."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.3 or more. It is fitted on the labelled rows among docs, at most
    quality.SAMPLE of them. Null and empty texts are scored like others, rows that repeat are each scored."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", QUALITY_FOLD)
    return quality.keep(docs, model, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links on 5-word shingles at a similarity of 0.8: that of the smallest doc_id, or,
    where no row of it has one, of the smallest hash of its text. A document without words stays. Rows are told apart by id
    and text; of rows that repeat both, one stays."""
    found = ngram_jaccard.join(docs.select(_row().alias("doc_id"), "text"), size=5, percent=80)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.withColumn("_row", _row()).join(kept, F.col("_row") == F.col("_kept"), "left_semi").drop("_row").dropDuplicates(["doc_id", "text"])


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 400-byte strings that occur elsewhere; n_chars follows the text. A document of which
    nothing but white space is left goes, if something was taken from it. Null and repeated texts as in suffix_dedup.clean."""
    cleaned = suffix_dedup.clean(docs, 400, changed="_changed").where(~F.col("_changed") | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("_changed"), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cleaned.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than a twentieth of the words, or none, lie in 13-word windows of the benchmark."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens. A null text is empty and still has its end token; rows
    without id, or that repeat, are packed each."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2, limit=TOKEN_LIMIT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents table. Each result is stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *steps, (_, last) = STAGES
    for number, (name, stage) in enumerate(steps):
        before, docs = docs, shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if number:
            shared.dropped(before)
    return last(spark, docs, sf_dir)
