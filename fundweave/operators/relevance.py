"""What remains of the matches: score floor, enough of them, no near repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fundweave import fixed_values as fv


def relevant(matches: DataFrame, min_score: float | None = None) -> DataFrame:
    return matches.filter(F.col("score") >= F.lit(min_score or fv.MIN_SCORE))


def enough(matches: DataFrame, min_score: float | None = None, min_chunks: int | None = None) -> DataFrame:
    """Relevant matches of the questions that have at least ``min_chunks`` of them."""
    per_question = Window.partitionBy("question_id")
    return (
        relevant(matches, min_score)
        .withColumn("_n", F.count("*").over(per_question))
        .filter(F.col("_n") >= (min_chunks or fv.MIN_CHUNKS)).drop("_n")
    )


def validation_status(questions: DataFrame, valid: DataFrame) -> DataFrame:
    """One row per question: how many matches stand, or the refusal."""
    counts = valid.groupBy("question_id").agg(F.count("*").alias("kept"))
    return questions.select("question_id").join(counts, "question_id", "left").select(
        "question_id",
        F.coalesce("kept", F.lit(0)).alias("kept"),
        F.when(F.col("kept").isNull(), F.lit(fv.REFUSAL)).alias("error"),
    )


def _kept_by_gap(scored: Column, gap: float) -> Column:
    """Walk best to worst; keep what lies at least ``gap`` below the last one kept.

    Scores descend, so the last one kept is the nearest of all kept.
    """
    empty = F.filter(scored, lambda _: F.lit(False))
    return F.aggregate(
        scored, empty,
        lambda kept, m: F.when(
            (F.size(kept) == 0) | (F.abs(m["score"] - F.element_at(kept, -1)["score"]) >= gap),
            F.concat(kept, F.array(m)),
        ).otherwise(kept),
    )


def drop_near_repeats(matches: DataFrame, gap: float = fv.DUPLICATE_GAP) -> DataFrame:
    """At most k matches per question exist, so a group is a short array. No fund equals no fund."""
    whole_row = F.struct(F.col("rank").alias("_order"), *matches.columns)
    return (
        matches.groupBy("question_id", "fund")
        .agg(F.sort_array(F.collect_list(whole_row)).alias("_m"))
        .select(F.explode(_kept_by_gap(F.col("_m"), gap)).alias("_m"))
        .select(*(F.col(f"_m.{name}").alias(name) for name in matches.columns))
    )


def retrieval_stats(matches: DataFrame) -> DataFrame:
    fund = F.coalesce("fund", F.lit(fv.UNKNOWN))
    source = F.coalesce("file", F.lit(fv.UNKNOWN))
    return matches.groupBy("question_id").agg(
        F.count("*").alias("total_chunks"),
        F.size(F.collect_set(fund)).alias("unique_funds"),
        F.array_join(F.array_sort(F.collect_set(fund)), ",").alias("funds"),
        F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"),
        F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )


def strong_share(matches: DataFrame, above: float = fv.STRONG_SCORE) -> DataFrame:
    """Share of retrieved chunks that score higher than ``above``."""
    return matches.agg(F.avg((F.col("score") > above).cast("double")).alias("strong_share"))
