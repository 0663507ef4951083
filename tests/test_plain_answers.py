"""Answers by search alone, where there are many questions and their contexts are long."""

import contextlib
import io

from pyspark.sql import functions as F

from fundweave import fixed_values as fv
from fundweave.plans import answer_batch as ab, plain_retrieval as pr

VECTORS = "namespace string, chunk_id string, embedding array<float>, fund string, file string, has_pl boolean, text string"


def _vectors(spark):
    """Four chunks that every question of two words finds, and one that none does."""
    found = [("holdings", f"h{i}", [1.0, 0.1 * i], f"F{i}", "holdings", True, f"text {i} " * 50) for i in range(4)]
    return spark.createDataFrame([*found, ("trades", "t", [0.0, 0.0], "F", "trades", None, "never")], VECTORS)


def _embed(column):
    return F.when(column == "nothing", F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_contexts_are_not_shuffled_for_each_question(spark):
    """The ids of the questions meet first, then the contexts of the different questions."""
    asked = spark.createDataFrame([(i, f"question {i % 3}") for i in range(12)], "question_id long, question string")
    found = pr.contexts(asked, _vectors(spark), embed=_embed, dim=2)
    assert found.columns == ["question_id", "question", "context", "error", "prompt"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]  # the last one first
    assert "[_asked" in joins[0] and "LeftOuter" in joins[0] and "[question_id" in joins[1]
    assert found.count() == 12


def test_repeated_ids_and_questions_without_matches(spark):
    """An id that two questions have meets both contexts, as the join by id always did; one without an id meets none."""
    asked = spark.createDataFrame([(1, "first"), (1, "nothing"), (2, "nothing"), (None, "first")], "question_id long, question string")
    rows = pr.contexts(asked, _vectors(spark), embed=_embed, dim=2).collect()
    assert sorted((r["question_id"], r["question"], r["context"] is None) for r in rows) == [
        (1, "first", False), (1, "first", True), (1, "nothing", False), (1, "nothing", True), (2, "nothing", True)]
    for r in rows:
        assert (r["error"], r["prompt"]) == (fv.REFUSAL, None) if r["context"] is None else r["context"] in r["prompt"]


def test_only_prompts_go_to_the_generator(spark):
    """Contexts and other columns do not pass through Python."""
    sent = spark.createDataFrame(
        [(1, "a context", "prompt one", True), (2, None, None, False), (3, "c", "fails", None), (4, "", "", True)],
        "question_id long, context string, prompt string, flag boolean")

    def load():
        def ask(prompt):
            if prompt == "fails":
                raise RuntimeError("no luck")
            return prompt.upper()
        return ask

    done = ab.generate(sent, load)
    assert done.columns == [*sent.columns, "answer", "failure"]
    plan = _plan(done)
    assert "MapInPandas" not in plan and "ArrowEvalPython" in plan
    rows = {r["question_id"]: (r["context"], r["flag"], r["answer"], r["failure"]) for r in done.collect()}
    assert rows == {1: ("a context", True, "PROMPT ONE", None), 2: (None, False, None, None),
                    3: ("c", None, None, "no luck"), 4: ("", True, fv.NO_ANSWER, None)}


def test_generator_is_called_once_for_each_prompt(spark, tmp_path):
    """Also when answer and failure are both asked for, and a filter stands behind them."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        import uuid
        return lambda prompt: (calls / f"{prompt}-{uuid.uuid4().hex}").write_text("") and "" or "said"

    sent = spark.range(20).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    done = ab.generate(sent, load).filter("answer = 'said' and failure is null").select("id", F.length("answer"), "answer")
    assert len(done.collect()) == 20 and len(list(calls.iterdir())) == 20
