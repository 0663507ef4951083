"""Which way a question goes: full statistics or search, and where to search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from fundweave import fixed_values as fv


def _contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(word) for word in words))


def query_type(question: Column) -> Column:
    """``aggregation`` if any pattern occurs. ``(?d)``: only a line feed ends a line."""
    pattern = "(?d)" + "|".join(fv.AGGREGATION_PATTERNS)
    return F.when(F.lower(question).rlike(pattern), F.lit("aggregation")).otherwise(F.lit("specific"))


def needs_pl(question: Column) -> Column:
    return _contains_any(F.lower(question), fv.PL_WORDS)


def namespace(question: Column) -> Column:
    """Holding words win over trade words, those over profit words; null means both."""
    text = F.lower(question)
    return (
        F.when(_contains_any(text, fv.HOLDING_WORDS), F.lit(fv.HOLDINGS))
        .when(_contains_any(text, fv.TRADE_WORDS), F.lit(fv.TRADES))
        .when(_contains_any(text, fv.PL_WORDS), F.lit(fv.HOLDINGS))
    )


def wants_cash(question: Column) -> Column:
    text = F.lower(question)
    return text.contains("total") & text.contains("cash")


def route(questions: DataFrame, auto_classify: bool = True) -> DataFrame:
    """Add ``query_type``, ``need_pl``, ``namespace`` and ``wants_cash``.

    With ``auto_classify=False`` the search is left unfiltered in both namespaces.
    """
    question = F.col("question")
    return questions.withColumns({
        "query_type": query_type(question),
        "need_pl": needs_pl(question) if auto_classify else F.lit(False),
        "namespace": namespace(question) if auto_classify else F.lit(None).cast("string"),
        "wants_cash": wants_cash(question),
    })
