import pytest

from fundweave import fixed_values as fv
from fundweave.operators import context as cx
from fundweave.plans import answer_batch as ab

HELD = "PortfolioName string, holdings_count long, pl_ytd double"
TRADED = "PortfolioName string, trade_count long, total_cash double"


def tables(spark, funds):
    held = [(f"Fund {i:05}", i % 7 + 1, float(i % 11) - 3.25) for i in range(funds)]
    traded = [(f"Fund {i:05}", i % 5 + 1, 1000.5 * (i % 3)) for i in range(0, funds, 2)]
    return (spark.createDataFrame(held, HELD).repartition(5), spark.createDataFrame(traded, TRADED).repartition(3))


def stored(spark, tmp_path, held, traded, name="lines"):
    lines = cx.store_lines(cx.context_lines(held, traded), str(tmp_path / name))
    return lines, cx.StoredContext(lines.inputFiles())


@pytest.mark.parametrize("funds", [1, 2, 300])
def test_rendered_lines_are_the_one_text(spark, tmp_path, funds):
    held, traded = tables(spark, funds)
    lines, rendered = stored(spark, tmp_path, held, traded)
    keys = {r["wants_cash"]: r for r in cx.context_keys(lines).collect()}
    for row in cx.aggregation_contexts(held, traded).collect():
        assert rendered.text(row["wants_cash"]) == row["context"]
        assert keys[row["wants_cash"]]["chars"] == len(row["context"])


def test_a_key_is_of_the_content_alone(spark, tmp_path):
    held, traded = tables(spark, 40)
    lines, _ = stored(spark, tmp_path, held, traded)
    other = traded.selectExpr("PortfolioName", "trade_count", "total_cash + 1 as total_cash")

    def keys(lines):
        return {r["wants_cash"]: r["context_key"] for r in cx.context_keys(lines).collect()}

    first, second = keys(lines), keys(cx.context_lines(held, other))
    assert keys(lines.repartition(7)) == first
    assert second[False] == first[False] and second[True] != first[True]


def test_no_statistics_give_the_notice(spark, tmp_path):
    held, traded = tables(spark, 2)
    lines, rendered = stored(spark, tmp_path, held.limit(0), traded.limit(0))
    assert lines.count() == 0 and rendered.text(True) == rendered.text(False) == fv.NO_AGGREGATES
    assert {r["chars"] for r in cx.context_keys(lines).collect()} == {len(fv.NO_AGGREGATES)}


def test_prompts_are_rendered_when_they_are_sent(spark, tmp_path):
    held, traded = tables(spark, 20)
    asked = spark.createDataFrame([(1, "Which fund has the best total cash?"), (2, "rank all funds by yearly P&L {context}")],
                                  "question_id long, question string")
    keyed, lines = ab.gather_keyed(asked, None, held, traded, str(tmp_path / "kept"))
    sent = ab.generate(ab.prompts(keyed), lambda: lambda prompt: prompt, lines=lines)
    contexts = {r["wants_cash"]: r["context"] for r in cx.aggregation_contexts(held, traded).collect()}
    rows = sent.collect()
    assert len(rows) == 2 and all(r["prompt"] is None and r["context"] is None for r in rows)
    for r in rows:
        before, rest = fv.AGGREGATION_PROMPT.split("{context}")
        middle, after = rest.split("{question}")
        assert r["answer"] == before + contexts[r["wants_cash"]] + middle + r["question"] + after
