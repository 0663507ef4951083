"""The plain way from questions to answers: every question is searched, none goes to the statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fundweave import fixed_values as fv
from fundweave.functions import answers as an
from fundweave.functions.routing import route
from fundweave.operators import context as cx
from fundweave.plans import answer_batch as ab


def contexts(questions: DataFrame, vectors: DataFrame, auto_classify: bool = True, **options) -> DataFrame:
    """``question_id, question, context, error, prompt``: what is found for each question, in the strict prompt; the refusal
    and no prompt where too little was.

    Questions meet by their ids before they meet their contexts, which are many times as long and are of few different
    questions: so no context is shuffled or sorted for each question.
    """
    routed = route(questions, auto_classify)
    asked = questions.select("question_id", "question").join(routed.select("question_id", ab.asked_id().alias("_asked")), "question_id")
    found = asked.join(ab.different_contexts(routed, vectors, **options), "_asked", "left").drop("_asked")
    return found.withColumns({
        "error": ab.refusal_without("context"), "prompt": cx.system_prompt(F.col("context"), F.col("question"))})


def answers(questions: DataFrame, vectors: DataFrame, load: Callable[[], Callable[[str], str]], auto_classify: bool = True,
            pause: float = 0.0, **options) -> DataFrame:
    """``question_id, answer, context, error`` of every question.

    A refused question is answered by the refusal and has no context. The answer to a failed call says what failed; an
    answer that is no valid one is replaced by the refusal and keeps its context.
    """
    done = ab.generate(contexts(questions, vectors, auto_classify, **options), load, pause)
    said = F.coalesce(an.failure_message(F.col("failure")), F.col("answer"))
    return done.select(
        "question_id",
        F.coalesce("error", an.or_refusal(said, an.is_valid_answer(said))).alias("answer"),
        F.when(F.col("error").isNotNull(), F.lit("")).otherwise(F.col("context")).alias("context"),
        "error",
    )


def replies(results: DataFrame) -> DataFrame:
    """Answers of either way as they leave the service: cleaned twice, with their type, which is unknown here."""
    kind = F.col("query_type") if "query_type" in results.columns else F.lit(None).cast("string")
    return results.select(
        "question_id", ab.reply_text(F.coalesce("answer", F.lit(""))).alias("answer"),
        F.coalesce(kind, F.lit(fv.UNKNOWN_TYPE)).alias("query_type"), "error")
