import datetime as dt
import math

from pyspark.sql import functions as F

from fundweave.operators import chunks as ch
from fundweave.sources import csv_tables as ct


def column(spark, values, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_missing_tokens(spark):
    assert column(spark, ["NULL", "null", "", "N/A", "<NA>", "#N/A", "none", " ", "x"], ct.missing_as_null) == [
        None, None, None, None, None, None, "none", " ", "x"]


def test_numbers(spark):
    found = column(spark, ["1,234", "abc", "1.5d", "2f", None, " 12 ", "-3.5", "1e3", ".5", "5.", "inf", "-Infinity", "0x1A"], ct.number)
    assert found[:10] == [0, 0, 0, 0, 0, 12, -3.5, 1000, 0.5, 5]
    assert found[10] == math.inf and found[11] == -math.inf and found[12] == 0


def test_dates(spark):
    found = column(spark, ["01/08/70", "01/08/68", "01/08/69", "1/8/23", "01/08/2023", "31/02/20", "xx", None, "29/02/00", "29/02/72"], ct.day)
    assert found == [dt.date(1970, 8, 1), dt.date(2068, 8, 1), dt.date(1969, 8, 1), dt.date(2023, 8, 1), None, None,
                     None, None, dt.date(2000, 2, 29), dt.date(1972, 2, 29)]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "b.csv").write_text(
        'PortfolioName,SecName,Qty,OpenDate,CloseDate,DirectionName,PL_YTD\n'
        'Alpha,"Last, ""quoted""",5,01/02/21,,Long,1.5\n')
    (tmp_path / "a.csv").write_text(
        'PortfolioName,SecName,Qty,OpenDate,CloseDate,DirectionName,PL_YTD\n'
        'Alpha,First,NULL,1/2/21,03/04/22,,abc\n'
        'Alpha,Second,"1,000",bad,N/A,Short,\n')
    df = ct.load_holdings(spark, str(tmp_path))
    rows = df.orderBy("row_ord").collect()
    assert [r["SecName"] for r in rows] == ["First", "Second", 'Last, "quoted"']
    assert [r["Qty"] for r in rows] == [0, 0, 5]
    assert [r["PL_YTD"] for r in rows] == [0, 0, 1.5]
    assert [r["DirectionName"] for r in rows] == ["Unknown", "Short", "Long"]
    assert [r["close_label"] for r in rows] == ["2022-04-03 00:00:00", "Open", "Open"]
    assert [r["is_open"] for r in rows] == [False, True, True]
    assert [r["bad_cells"] for r in rows] == [0, 1, 0]
    assert "Price" not in df.columns
    assert ct.cell_report(df).first().asDict() == {"rows": 3, "bad_cells": 1}


def test_order_survives_splits_and_storage(spark, tmp_path):
    """Small splits: rows of one file are read by many tasks and still come back in order."""
    lines = "".join(f"F{i % 3},{i}\n" for i in range(5000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("PortfolioName,Name\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = ct.load_trades(spark, str(tmp_path / "in"))
        assert df.rdd.getNumPartitions() > 5
        stored = ct.store(df, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    names = [r["Name"] for r in stored.orderBy("row_ord").collect()]
    assert names == [str(i) for i in range(5000)]
    rows = stored.select(F.lit("trades").alias("namespace"), F.col("PortfolioName").alias("fund"), "row_ord",
                         F.col("Name").alias("text"))
    packed = ch.pack_rows(rows, max_tokens=7, block_rows=16).collect()
    for fund in ("F0", "F1", "F2"):
        mine = sorted((int(r["text"]), r["n_tokens"], r["chunk_no"]) for r in packed if r["fund"] == fund)
        number = held = count = 0
        for _, tokens, chunk in mine:
            if count and held + tokens > 7:
                number, held, count = number + 1, 0, 0
            held, count = held + tokens, count + 1
            assert chunk == number
