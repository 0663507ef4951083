import pytest
from pyspark.sql import functions as F

from fundweave import fixed_values as fv
from fundweave.functions import answers as an, routing, text as tx, tokens as tk, vectors as vec
from fundweave.operators import context as cx, evaluate as ev, stats

# question, type, namespace, needs profit rows
LABELS = [
    ("Tell me what the Larkspur desk owns", "specific", "holdings", False),
    ("Count every position of Larkspur", "specific", "holdings", False),
    ("Which fund, on all counts, is best?", "aggregation", None, False),
    ("Which fund performed so well this year?", "aggregation", None, False),
    ("Which fund did better on yearly profit?", "aggregation", "holdings", True),
    ("Please compare the five funds", "aggregation", None, False),
    ("Show top ten funds by return", "aggregation", "holdings", True),
    ("Rank my funds by loss", "aggregation", "holdings", True),
    ("Give cash of all funds", "aggregation", None, False),
    ("Is fund performance falling?", "aggregation", "holdings", True),
    ("Who has the highest p/l of the year?", "aggregation", None, False),
    ("The lowest p&l so far", "aggregation", "holdings", True),
    ("Are there funds that fare worse?", "aggregation", None, False),
    ("How often did Juniper sell in May?", "specific", "trades", False),
    ("List each purchase by Juniper", "specific", "trades", False),
    ("Is there profit in Juniper's latest transaction?", "specific", "trades", True),
    ("Yearly numbers of Juniper", "specific", "holdings", True),
    ("Who audits Juniper?", "specific", None, False),
    ("When was Juniper founded?", "specific", None, False),
    ("Total cash for all funds of the house", "aggregation", None, False),
    ("top\x85funds", "aggregation", None, False),
    ("top\nfunds", "specific", None, False),
]


def test_routing_table(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(LABELS)], "question_id int, question string")
    found = routing.route(df).orderBy("question_id").collect()
    assert [(r["question"], r["query_type"], r["namespace"], r["need_pl"]) for r in found] == LABELS
    assert [r["question"] for r in found if r["wants_cash"]] == ["Total cash for all funds of the house"]
    open_search = routing.route(df, auto_classify=False).collect()
    assert all(r["namespace"] is None and not r["need_pl"] for r in open_search)


def test_numbers_read_like_the_reports(spark):
    values = [2.5, 3.5, 1.005, 2.675, 1234567.125, -0.001, -944.345, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    found = [r[0] for r in df.select(tx.number_text(F.col("v"), 2)).collect()]
    assert found == [f"{v:,.2f}" for v in values]
    assert [r[0] for r in df.select(tx.number_text(F.col("v"), 0)).collect()] == [f"{v:,.0f}" for v in values]


def test_missing_cells_in_row_text(spark):
    df = spark.sql("""select cast(null as string) SecName, 'Unknown' SecurityTypeName, 'A' PortfolioName, 2.5D Qty, 1.005D Price,
        1e6D MV_Base, -1.5D PL_YTD, 0D PL_QTD, 's' Strategy1RefShortName, cast(null as string) CustodianName, 'Long' DirectionName,
        cast(null as date) OpenDate""")
    lines = df.select(tx.holdings_text(df)).first()[0].split("\n")
    assert lines == ["Security: nan (Unknown)", "Portfolio: A", "Quantity: 2", "Price: $1.00", "Market Value (Base): $1,000,000.00",
                     "P&L Year-to-Date: $-1.50", "P&L Quarter-to-Date: $0.00", "Strategy: s", "Custodian: nan", "Direction: Long",
                     "Open Date: NaT", "---"]


def test_prompt_leaves_braces_alone(spark):
    df = spark.createDataFrame([("a {question} b", "why {context}?")], "context string, question string")
    found = df.select(cx.prompt(F.lit("aggregation"), F.col("context"), F.col("question"))).first()[0]
    assert found == fv.AGGREGATION_PROMPT.format(context="a {question} b", question="why {context}?")
    found = df.select(cx.system_prompt(F.col("context"), F.col("question"))).first()[0]
    assert found == fv.SYSTEM_PROMPT.format(context="a {question} b", question="why {context}?")


@pytest.mark.parametrize("raw, clean", [("\t a\tb\r\nc \x00\x7f ", "ab\nc"), (" x ", "x"), ("  ", ""), (None, None)])
def test_cleaning_is_stable(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "a string")
    once = df.select(tx.clean_answer(F.col("a")).alias("a"))
    assert once.first()[0] == clean
    assert once.select(tx.clean_answer(F.col("a"))).first()[0] == clean


def test_answers(spark):
    texts = ["Sorry, we CANNOT FIND it", "sorry", "  123456789 \n", "1234567890", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string").orderBy("i")
    valid = an.is_valid_answer(F.col("a"))
    assert [r[0] for r in df.select(valid).collect()] == [True, False, False, True, None]
    assert [r[0] for r in df.select(an.or_refusal(F.col("a"), valid)).collect()] == [
        texts[0], fv.REFUSAL, fv.REFUSAL, "1234567890", fv.REFUSAL]
    assert [r[0] for r in df.select(ev.answered(F.col("a"))).collect()] == [False, False, True, True, None]
    bands = []
    for n_passed in (10, 8, 7):
        results = spark.createDataFrame([(i < n_passed,) for i in range(10)], "passed boolean")
        bands.append(ev.pass_summary(results).first()["band"])
    assert bands == ["all passed", "mostly passed", "many failed"]
    assert ev.pass_summary(spark.createDataFrame([], "passed boolean")).first()["pass_rate"] == 0


def test_no_statistics(spark):
    held = spark.createDataFrame([], "PortfolioName string, Qty double, PL_YTD double, PL_QTD double, PL_MTD double, PL_DTD double")
    traded = spark.createDataFrame([], "PortfolioName string, TradeTypeName string, TotalCash double")
    found = cx.aggregation_contexts(stats.holdings_by_fund(held), stats.trades_by_fund(traded)).collect()
    assert {r["context"] for r in found} == {fv.NO_AGGREGATES}


def test_sums_are_exact(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", -0.3), ("b", 1e15), ("b", 0.25), ("c", 1e19), (None, 5.0)],
                               "PortfolioName string, TotalCash double").withColumn("TradeTypeName", F.lit("Buy"))
    found = {r[0]: r["total_cash"] for r in stats.trades_by_fund(df).collect()}
    assert found == {"a": 0.0, "b": 1e15 + 0.25, "c": 1e19}
    ties = stats.rank_funds(stats.trades_by_fund(df), "trade_count").orderBy("rank").collect()
    assert [(r["rank"], r["PortfolioName"]) for r in ties] == [(1, "a"), (2, "b"), (3, "c")]


def test_hooks(spark):
    class Letters:
        def encode(self, text):
            return list(text)
    class Lengths:
        def encode(self, texts):
            assert len(texts) <= 32
            return [[len(t), 1.0] for t in texts]

    df = spark.range(100).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    found = df.select(tk.tokenizer_hook(Letters)("t").alias("n"), vec.model_hook(Lengths)("t").alias("v")).collect()
    assert sorted(r["n"] for r in found) == list(range(100))
    assert all(r["v"] == [r["n"], 1.0] for r in found)


def test_rank_many(spark):
    df = spark.range(5000).select(F.concat(F.lit("g"), "id").alias("name"), (F.col("id") % 7).alias("value")).repartition(9)
    found = [(r["rank"], r["value"], r["name"]) for r in stats.rank_many(df, "value", "name").orderBy("rank").collect()]
    expected = sorted(((i % 7, f"g{i}") for i in range(5000)), key=lambda p: (-p[0], p[1]))
    assert found == [(n, v, g) for n, (v, g) in enumerate(expected, 1)]


def test_a_real_tokenizer(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")

    def load():
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        return tiktoken.Encoding("local", pat_str=r"\S+|\s+", mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})

    texts = ["Portfolio: Alpha\nQuantity: 17", "", "naïve über 漢字"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    found = [r[0] for r in df.select(tk.tokenizer_hook(load)("t")).collect()]
    assert found == [len(load().encode(t)) for t in texts]
