import os

from pyspark.sql import functions as F

from fundweave.streaming import renewal

COLUMNS = ("PortfolioName,SecName,SecurityTypeName,Qty,Price,MV_Base,PL_YTD,PL_QTD,PL_MTD,PL_DTD,Strategy1RefShortName,"
           "CustodianName,DirectionName,OpenDate,CloseDate,AsOfDate,SecurityId").split(",")


def drop(path, funds, first, rows):
    lines = [",".join(COLUMNS)]
    for i in range(first, first + rows):
        lines.append(f"{funds[i % len(funds)]},Bond {i},Bond,{i},10,100,{i - 3}.25,1,1,1,Macro,Bank,Long,01/02/21,,31/12/22,S{i}")
    path.write_text("\n".join(lines) + "\n")


def test_three_drops_add_their_rows(spark, tmp_path):
    drops, target = tmp_path / "drops", str(tmp_path / "index")
    drops.mkdir()

    def run():
        renewal.start(spark, str(drops), "holdings", COLUMNS, target, str(tmp_path / "checkpoint"),
                      rows_path=str(tmp_path / "rows")).awaitTermination()
        return {r["fund"]: r["n"] for r in renewal.current(spark, target).groupBy("fund").agg(F.sum("row_count").alias("n")).collect()}

    drop(drops / "1.csv", ("Alpha", "Beta"), 0, 20)
    assert run() == {"Alpha": 10, "Beta": 10}
    drop(drops / "2.csv", ("Beta", "Gamma"), 100, 8)
    assert run() == {"Alpha": 10, "Beta": 14, "Gamma": 4}
    drop(drops / "0.csv", ("Beta", "Gamma", "Alpha"), 200, 3)
    assert run() == {"Alpha": 11, "Beta": 15, "Gamma": 5}
    beta = renewal.current(spark, target).where("fund = 'Beta'").orderBy("chunk_id").select("text").collect()
    text = "\n".join(r["text"] for r in beta)
    assert text.index("Bond 19") < text.index("Bond 100") < text.index("Bond 201")

    assert renewal.retire(spark, target) == [0, 1]
    assert [x for x in os.listdir(target) if x.startswith("version=")] == ["version=2"]
    assert run() == {"Alpha": 11, "Beta": 15, "Gamma": 5}
