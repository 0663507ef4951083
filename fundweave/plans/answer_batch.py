"""Batches of questions: route, gather context, build prompts, collect answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fundweave import fixed_values as fv
from fundweave.functions import text as tx
from fundweave.functions.routing import route
from fundweave.functions.vectors import Embedder, hashed_counts
from fundweave.operators import context as cx, relevance as rv, search, stats


def retrieve(
    questions: DataFrame,
    vectors: DataFrame,
    embed: Embedder | None = None,
    k: int | None = None,
    dim: int = fv.VECTOR_DIM,
    min_score: float | None = None,
    min_chunks: int | None = None,
    positive_only: bool = False,
) -> DataFrame:
    """Matches per routed question that survive the score floor, the minimum count and the gap rule."""
    asked = questions.select(
        "question_id", (embed or hashed_counts(dim))(F.col("question")).alias("embedding"), "namespace", "need_pl")
    found = search.top_k(vectors, asked, k, dim, positive_only)
    valid = rv.enough(found, min_score, min_chunks)
    return rv.drop_near_repeats(search.with_metadata(valid, vectors))


def asked_id() -> Column:
    """What a question is searched by: the hash of its text and of where it looks."""
    return F.md5(F.to_json(F.struct("question", "namespace", "need_pl")))


def reply_text(answer: Column) -> Column:
    """The text that leaves the service."""
    return tx.clean_reply(tx.clean_answer(answer))


def different_contexts(routed: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """``_asked, context``: the context of each different question for which enough is found.

    A batch repeats itself, so each different question is searched once.
    """
    different = ["question", "namespace", "need_pl"]
    asked = routed.select(*different).distinct().withColumn("question_id", asked_id())
    return cx.chunk_contexts(retrieve(asked, vectors, **options)).withColumnRenamed("question_id", "_asked")


def search_contexts(routed: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """Routed questions with the ``context`` found for them, null where too little was."""
    return (
        routed.withColumn("_asked", asked_id())
        .join(different_contexts(routed, vectors, **options), "_asked", "left").drop("_asked")
    )


def refusal_without(context: str) -> Column:
    return F.when(F.col(context).isNull(), F.lit(fv.REFUSAL))


def retrieve_and_validate(questions: DataFrame, vectors: DataFrame, auto_classify: bool = True, **options) -> DataFrame:
    """``question_id, context, error``: the numbered chunk texts, or the refusal."""
    found = search_contexts(route(questions, auto_classify), vectors, **options)
    return found.select("question_id", "context", refusal_without("context").alias("error"))


def gather_contexts(questions: DataFrame, vectors: DataFrame, holdings: DataFrame, trades: DataFrame, **options) -> DataFrame:
    """Every question with ``query_type, context, error`` along its own way."""
    routed = route(questions)
    aggregated = cx.attach_aggregates(
        routed.filter("query_type = 'aggregation'"),
        cx.aggregation_contexts(stats.holdings_by_fund(holdings), stats.trades_by_fund(trades)),
    ).select("question_id", "question", "query_type", "context", F.lit(None).cast("string").alias("error"))
    searched = search_contexts(routed.filter("query_type = 'specific'"), vectors, **options).select(
        "question_id", "question", "query_type", "context", refusal_without("context").alias("error"))
    return aggregated.unionByName(searched)


def gather_keyed(questions: DataFrame, vectors: DataFrame | None, holdings_stats: DataFrame, trades_stats: DataFrame,
                 path: str, **options) -> tuple[DataFrame, DataFrame]:
    """As gather_contexts, for any number of funds: the questions, and the stored lines of the aggregation context.

    The lines are written once, to ``path``. An aggregation question has their ``context_key`` and no context; ``generate``
    with these lines puts the text in when its prompt is sent. Without ``vectors`` only aggregation questions are kept.
    """
    routed = route(questions)
    lines = cx.store_lines(cx.context_lines(holdings_stats, trades_stats), path)
    none = F.lit(None).cast("string")
    asked = routed.filter("query_type = 'aggregation'").join(F.broadcast(cx.context_keys(lines)), "wants_cash").select(
        "question_id", "question", "query_type", none.alias("context"), none.alias("error"), "wants_cash", "context_key", "chars")
    if vectors is None:
        return asked, lines
    searched = search_contexts(routed.filter("query_type = 'specific'"), vectors, **options).select(
        "question_id", "question", "query_type", "context", refusal_without("context").alias("error"))
    return asked.unionByName(searched, allowMissingColumns=True), lines


def prompts(contexts: DataFrame) -> DataFrame:
    """Adds the filled-in prompt; a question without a context gets none."""
    return contexts.withColumn("prompt", cx.prompt(F.col("query_type"), F.col("context"), F.col("question")))


def generate(prompted: DataFrame, load: Callable[[], Callable[[str], str]], pause: float = 0.0,
             lines: DataFrame | None = None) -> DataFrame:
    """Adds ``answer`` and ``failure`` by calling ``load()`` once per task and its result per prompt.

    No generator is supplied. ``pause`` seconds pass between the calls of a task. A row with a ``context_key`` gets its
    prompt from the stored ``lines`` (of gather_keyed) just before it is sent; the text is in no row. Prompts alone go to
    Python, answers and failures alone come back; contexts and other columns stay where they are.
    """
    files = lines.inputFiles() if lines is not None else []
    keyed = ["context_key", "wants_cash", "question"] if lines is not None else []

    @F.arrow_udf("answer string, failure string")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import time

        ask: Any = load()
        called = False
        stored = cx.StoredContext(files)
        for batch in batches:
            answers, failures = [], []
            for row in batch:
                prompt = row["prompt"].as_py()
                if keyed and row["context_key"].is_valid:
                    prompt = stored.prompt(bool(row["wants_cash"].as_py()), row["question"].as_py())
                if prompt is None:
                    answers.append(None)
                    failures.append(None)
                    continue
                if called and pause:
                    time.sleep(pause)
                called = True
                try:
                    answers.append(ask(prompt) or fv.NO_ANSWER)
                    failures.append(None)
                except Exception as problem:  # a failed call is a result, not a failed job
                    answers.append(None)
                    failures.append(str(problem))
            said = [pa.array(answers, pa.string()), pa.array(failures, pa.string())]
            yield pa.StructArray.from_arrays(said, ["answer", "failure"])

    said = prompted.withColumn("_said", answer.asNondeterministic()(F.struct("prompt", *keyed)))
    return said.select(*prompted.columns, "_said.answer", "_said.failure")


def results(generated: DataFrame) -> DataFrame:
    """``question_id, query_type, context, answer, error`` as a caller of the batch gets them.

    A refused question keeps an empty type and context; a failed call is reported in the answer.
    """
    refused = F.col("error").isNotNull()
    return generated.select(
        "question_id",
        F.when(refused, F.lit("")).otherwise(F.col("query_type")).alias("query_type"),
        F.when(refused, F.lit("")).otherwise(F.col("context")).alias("context"),
        F.when(refused, F.col("error"))
        .when(F.col("failure").isNotNull(), F.concat(F.lit(fv.GENERATION_FAILED), F.col("failure")))
        .otherwise(tx.clean_answer(F.col("answer"))).alias("answer"),
        "error",
    )
