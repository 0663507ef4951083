"""Checks and substitutions on answer texts and failure texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fundweave import fixed_values as fv
from fundweave.functions.text import strip


def is_valid_answer(answer: Column) -> Column:
    """A refusal is valid; anything else needs some length after trimming."""
    text = F.lower(answer)
    refusal = text.contains("sorry") & text.contains("cannot find")
    return refusal | (F.char_length(strip(answer)) >= fv.MIN_ANSWER_CHARS)


def or_refusal(answer: Column, valid: Column | None = None) -> Column:
    """The answer, or the refusal where it is missing or not valid."""
    kept = answer if valid is None else F.when(valid, answer)
    return F.coalesce(kept, F.lit(fv.REFUSAL))


def failure_category(error: Column) -> Column:
    text = F.lower(error)
    return (
        F.when(text.contains("quota") | text.contains("rate limit"), F.lit("rate_limit"))
        .when(text.contains("api key"), F.lit("api_key"))
        .when(error.isNotNull(), F.lit("other"))
    )


def failure_message(error: Column) -> Column:
    category = failure_category(error)
    return (
        F.when(category == "rate_limit", F.lit(fv.RATE_LIMIT_MESSAGE))
        .when(category == "api_key", F.lit(fv.API_KEY_MESSAGE))
        .when(category == "other", F.concat(F.lit("❌ " + fv.GENERATION_FAILED), error))
    )


def says_sorry(answer: Column) -> Column:
    return F.lower(answer).rlike("sorry|cannot find")
