"""Scoring of answers against values computed from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fundweave.functions.answers import says_sorry
from fundweave.operators.stats import FUND, top_funds


def answered(answer: Column) -> Column:
    """Passes where an answer was due and none of the refusal words occur."""
    return ~says_sorry(answer)


def refused(answer: Column) -> Column:
    return says_sorry(answer)


def mentions_expected(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Joins the computed value to each answer and looks for it in the text."""
    return answers.join(expected, "question_id").withColumn(
        "passed", F.coalesce(F.col("answer").contains(F.col("expected")), F.lit(False)))


def top_fund_expected(questions: DataFrame, by_fund: DataFrame, measure: str = "pl_ytd") -> DataFrame:
    """``question_id, expected``: the name of the best fund, for questions that ask for it."""
    best = top_funds(by_fund, measure, 1).select(F.col(FUND).alias("expected"))
    return questions.select("question_id").join(F.broadcast(best), F.lit(True))  # one row


def namespace_passes(found: Column, expected: Column) -> Column:
    """A namespace check also passes where none was chosen."""
    return found.isNull() | found.eqNullSafe(expected)


def pass_summary(results: DataFrame) -> DataFrame:
    """Totals, pass rate and its band."""
    rate = F.col("passed_tests") / F.col("total_tests") * 100
    return results.agg(
        F.count("*").alias("total_tests"),
        F.count_if("passed").alias("passed_tests"),
        F.count_if(~F.col("passed")).alias("failed_tests"),
    ).withColumn("pass_rate", F.when(F.col("total_tests") > 0, rate).otherwise(F.lit(0.0))).withColumn(
        "band", F.when(F.col("pass_rate") == 100, "all passed").when(F.col("pass_rate") >= 80, "mostly passed")
        .otherwise("many failed"))
