import pytest
from pyspark.sql import functions as F

from fundweave import fixed_values as fv
from fundweave.operators import chunks as ch
from fundweave.plans import answer_batch as ab, build_index
from fundweave.sources import csv_tables as ct, vector_table as vt
from fundweave.streaming import renewal


def write_tables(folder, funds=("Alpha", "Beta"), rows=30):
    folder.mkdir(exist_ok=True)
    held = ["PortfolioName,SecName,SecurityTypeName,Qty,Price,MV_Base,PL_YTD,PL_QTD,PL_MTD,PL_DTD,Strategy1RefShortName,"
            "CustodianName,DirectionName,OpenDate,CloseDate,AsOfDate,SecurityId"]
    traded = ["PortfolioName,TradeTypeName,Name,SecurityType,Quantity,Price,TotalCash,Principal,TradeDate,SettleDate,Strategy1Name,"
              "CustodianName,Counterparty"]
    for i in range(rows):
        fund = funds[i % len(funds)]
        held.append(f"{fund},Bond {i},Bond,{i},10,100,{i - 3}.25,1,1,1,Macro,Bank,Long,01/02/21,,31/12/22,S{i}")
        traded.append(f"{fund},{'Buy' if i % 3 else 'Sell'},Share {i},Equity,{i},10,{i}.5,100,NULL,,Macro,Bank,Broker")
    (folder / "holdings.csv").write_text("\n".join(held) + "\n")
    (folder / "trades.csv").write_text("\n".join(traded) + "\n")


def test_build_search_and_answer(spark, tmp_path):
    def answer(prompt):
        if "Total Cash by Fund" in prompt:
            raise RuntimeError("quota")
        return "\tfine\r\n " if "COMPLETE" in prompt else ""

    write_tables(tmp_path / "in")
    holdings = ct.store(ct.load_holdings(spark, str(tmp_path / "in/holdings.csv")), str(tmp_path / "h"))
    trades = ct.store(ct.load_trades(spark, str(tmp_path / "in/trades.csv")), str(tmp_path / "t"))
    path = str(tmp_path / "index")
    counts = {r["namespace"]: (r["vectors"], r["dimension"]) for r in build_index.build(holdings, trades, path).collect()}
    assert counts[None][0] == counts["holdings"][0] + counts["trades"][0] and counts[None][1] == fv.VECTOR_DIM
    again = {r["namespace"]: (r["vectors"], r["dimension"]) for r in build_index.build(holdings, trades, path).collect()}
    assert again == counts  # a second build leaves no stale rows

    index = build_index.open_index(spark, path)
    assert vt.misfits(index).count() == 0
    first = index.filter("namespace = 'trades'").orderBy("chunk_id").first()
    assert "Trade Date: 00:00.0" in first["text"] and first["has_pl"] is None and first["trade_types"] == ["Buy", "Sell"]
    assert index.filter("namespace = 'holdings'").select("year").distinct().collect()[0][0] == 2022

    questions = spark.createDataFrame([
        (1, "Which fund performed best based on yearly P&L?"), (2, "How many holdings does Alpha have? Bond Long Macro Bank Price Security"),
        (3, "What is the profit on trades for Alpha?"), (4, "Total cash of all funds"), (5, "zzz qqq")], "question_id long, question string")
    contexts = ab.gather_contexts(questions, index, holdings, trades, min_score=0.1, min_chunks=2)
    done = {r["question_id"]: r for r in ab.results(ab.generate(ab.prompts(contexts), lambda: answer)).collect()}
    assert done[1]["context"].startswith("=== COMPLETE") and "1. Beta: $" in done[1]["context"] and "Cash" not in done[1]["context"]
    assert "=== Total Cash by Fund ===" in done[4]["context"]
    assert done[2]["context"].startswith("=== Chunk 1 (Fund: Alpha, Source: holdings") and done[2]["query_type"] == "specific"
    for q in (3, 5):
        assert (done[q]["answer"], done[q]["error"], done[q]["query_type"], done[q]["context"]) == (fv.REFUSAL, fv.REFUSAL, "", "")
    assert done[1]["answer"] == "fine" and done[4]["answer"] == "Error generating answer: quota"
    assert done[2]["answer"] == fv.NO_ANSWER


def test_create_table(spark, tmp_path):
    table = vt.create_table(spark, "vectors_a", str(tmp_path / "vectors_a"))
    assert table.count() == 0
    vt.create_table(spark, "vectors_a", str(tmp_path / "vectors_a"))
    with pytest.raises(ValueError):
        vt.create_table(spark, "vectors_a", dim=64)
    spark.sql("drop table vectors_a")


def test_renewal_only_rebuilds_changed_funds(spark, tmp_path):
    def rows(texts):
        return spark.createDataFrame(
            [("trades", f, i, t, None, "Buy", None, None) for i, (f, t) in enumerate(texts)],
            "namespace string, fund string, row_ord long, text string, security_type string, trade_type string, pl_row boolean, row_year int")

    before = rows([("a", "one"), ("a", "two"), ("b", "three"), ("c", "four")])
    after = rows([("a", "one"), ("a", "two"), ("b", "3"), ("d", "four")])
    stored = vt.to_vectors(ch.chunk_rows(before)).withColumn("year", F.lit(1))
    changes = {r["fund"]: r["change"] for r in vt.changed_funds(vt.fingerprints(before), vt.fingerprints(after)).collect()}
    assert changes == {"b": "changed", "c": "gone", "d": "new"}
    renewed = {r["fund"]: (r["text"], r["year"]) for r in build_index.renew(stored, vt.fingerprints(before), after).collect()}
    assert renewed == {"a": ("one\ntwo", 1), "b": ("3", None), "d": ("four", None)}
    swapped = rows([("a", "two"), ("a", "one"), ("b", "three"), ("c", "four")])
    assert [r["fund"] for r in vt.changed_funds(vt.fingerprints(before), vt.fingerprints(swapped)).collect()] == ["a"]


def test_dropped_files(spark, tmp_path):
    write_tables(tmp_path / "first", ("Alpha", "Beta"), 20)
    write_tables(tmp_path / "second", ("Beta", "Gamma"), 8)
    columns = (tmp_path / "first/holdings.csv").read_text().split("\n")[0].split(",")
    drops = tmp_path / "drops"
    drops.mkdir()
    target, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")

    def run():
        renewal.start(spark, str(drops), "holdings", columns, target, checkpoint).awaitTermination()
        return {r["fund"]: r["n"] for r in renewal.current(spark, target).groupBy("fund").agg(F.sum("row_count").alias("n")).collect()}

    (drops / "1.csv").write_text((tmp_path / "first/holdings.csv").read_text())
    assert run() == {"Alpha": 10, "Beta": 10}
    assert run() == {"Alpha": 10, "Beta": 10}
    (drops / "2.csv").write_text((tmp_path / "second/holdings.csv").read_text())
    assert run() == {"Alpha": 10, "Beta": 4, "Gamma": 4}
