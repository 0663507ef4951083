"""Sums that round nothing, whole texts, stable fingerprints, one row per key, emptied namespaces."""

import pytest
from pyspark.sql import functions as F

from fundweave.functions import vectors as vec
from fundweave.operators import search, stats
from fundweave.plans import build_index
from fundweave.sources import csv_tables as ct, vector_table as vt
from fundweave.operators import chunks as ch


def test_small_amounts_are_summed_in_full(spark):
    df = spark.range(1000).select(F.lit("A").alias("g"), F.lit(0.00004).alias("x"))
    assert df.groupBy("g").agg(stats.money_sum("x").alias("s")).first()["s"] == 0.04


def test_one_huge_amount_changes_no_rule(spark):
    df = spark.createDataFrame([(1e19,), (0.00004,), (-1e19,), (float("nan"),), (None,)], "x double")
    assert df.agg(stats.money_sum("x").alias("s")).first()["s"] == 0.00004


@pytest.mark.parametrize(("amounts", "total"), [
    ([9e18] * 20, 1.8e20),
    ([1e19] * 20, 2e20),
    ([1e300, 5.0, None], 1e300),
    ([1e300, -1e300, 0.25], 0.25),
    ([float("inf"), 5.0], float("inf")),
    ([float("-inf"), 1e300, 5.0], float("-inf")),
    ([9999999999999.99, 0.01, -1e13], 0.0),
    ([1234567890.1234567, -1234567890.0], 0.1234567),
    ([999999999.9999999, 0.0000001, -1e9], 0.0),
    ([-1e9, 1e9 + 0.5, 0.1, 0.2], 0.8),
    ([5e-324, 0.1, 0.2], 0.3),
    ([None, float("nan")], None),
    ([float("nan"), 2.0], 2.0),
])
def test_no_amount_is_too_large_to_be_summed(spark, amounts, total):
    for rows in (amounts, amounts[::-1]):
        df = spark.createDataFrame([(x,) for x in rows], "`an x` double")
        assert df.agg(stats.money_sum("an x").alias("s")).first()["s"] == total


def test_infinite_amounts_of_unlike_sign_have_no_sum(spark):
    import math

    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "x double")
    assert math.isnan(df.agg(stats.money_sum("x").alias("s")).first()["s"])


def test_sums_are_those_of_decimals(spark):
    from decimal import Decimal
    import random

    draw = random.Random(3)
    rows = [(k % 3, draw.choice([1, -1]) * round(draw.random() * 10 ** draw.randint(-3, 16), draw.randint(0, 6))) for k in range(600)]
    df = spark.createDataFrame(rows, "g int, x double")
    found = {r["g"]: r["s"] for r in df.groupBy("g").agg(stats.money_sum("x").alias("s")).collect()}
    assert found == {g: float(sum(Decimal(str(x)) for h, x in rows if h == g)) for g in range(3)}


def test_all_cells_are_exact_for_every_number_of_planes(spark):
    import numpy as np

    draw = np.random.default_rng(0)
    rows = [(str(i), "holdings", [float(v) for v in draw.normal(size=8)], "A", "f", True, "t") for i in range(200)]
    vectors = spark.createDataFrame(rows, "chunk_id string, namespace string, embedding array<float>, fund string, file string, has_pl boolean, text string")
    asked = vectors.limit(20).select(F.col("chunk_id").alias("question_id"), "embedding", F.lit(None).cast("string").alias("namespace"), F.lit(False).alias("need_pl"))
    key = lambda df: sorted((r["question_id"], r["chunk_id"]) for r in df.collect())
    assert key(search.approximate_top_k(search.with_cells(vectors, 8, 4), asked, 5, 8, bits=4, probes=16)) == key(search.top_k(vectors, asked, 5, 8))
    with pytest.raises(ValueError):
        search.approximate_top_k(search.with_cells(vectors, 8, 2), asked, 5, 8, bits=2, probes=5)


def test_fingerprints_do_not_depend_on_other_files(spark, tmp_path):
    def write(folder, name, fund):
        (tmp_path / folder).mkdir(exist_ok=True)
        lines = [f"01/08/23,Buy,{fund},{k},1,1,1,1,01/08/23,S,N{k},T,C,P" for k in range(5)]
        header = "TradeDate,TradeTypeName,PortfolioName,Quantity,Price,Principal,TotalCash,AllocationCash,SettleDate,SecurityType,Name,Strategy1Name,CustodianName,Counterparty"
        (tmp_path / folder / name).write_text("\n".join([header, *lines]))

    def marks(folder):
        return vt.fingerprints(ch.trades_rows(ct.load_trades(spark, str(tmp_path / folder / "*.csv"))))

    write("a", "one.csv", "Alpha")
    write("a", "two.csv", "Beta")
    before = spark.createDataFrame(marks("a").collect(), marks("a").schema)
    for name, fund in (("one.csv", "Alpha"), ("two.csv", "Beta"), ("a_third.csv", "Gamma")):
        write("moved", name, fund)
    assert [tuple(r) for r in vt.changed_funds(before, marks("moved")).collect()] == [("trades", "Gamma", "new")]


def test_fingerprints_depend_on_a_funds_own_rows_alone(spark, tmp_path):
    header = "TradeDate,TradeTypeName,PortfolioName,Quantity,Price,Principal,TotalCash,AllocationCash,SettleDate,SecurityType,Name,Strategy1Name,CustodianName,Counterparty"

    def write(name, rows):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join([header, *(f"01/08/23,Buy,{fund},{k},1,1,1,1,01/08/23,S,N{k},T,C,P" for fund, k in rows)]))
        return str(path)

    def marks(*paths, split="128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            found = vt.fingerprints(ch.trades_rows(ct.load_trades(spark, list(paths))))
            return spark.createDataFrame(found.collect(), found.schema)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    def change(before, after):
        return sorted((r["fund"], r["change"]) for r in vt.changed_funds(before, after).collect())

    large = [("Alpha" if k % 3 else "Beta", k) for k in range(3000)]
    one = write("a/one.csv", large)
    before = marks(one)
    assert change(before, marks(one, split="9000")) == []  # other split borders
    assert change(before, marks(one, write("a/two.csv", [("Gamma", 1)]), split="20000")) == [("Gamma", "new")]
    assert change(before, marks(one, write("b/one.csv", [("Gamma", 1)]))) == [("Gamma", "new")]  # the same name elsewhere
    assert change(before, marks(write("c/one.csv", [("Delta", 7), *large]))) == [("Delta", "new")]  # rows of others between
    swapped = [*large[:10], large[11], large[10], *large[12:]]
    assert change(before, marks(write("d/one.csv", swapped))) == [("Alpha", "changed")]
    assert change(before, marks(write("e/one.csv", large[:-1]))) == [(large[-1][0], "changed")]


def test_upsert_keeps_one_row_of_a_key(spark):
    stored = spark.createDataFrame([("n", "1", "old"), ("n", "2", "stays")], "namespace string, chunk_id string, text string")
    incoming = spark.createDataFrame([("n", "1", "a"), ("n", "1", "b")], stored.schema)
    assert sorted(r["text"] for r in vt.upsert(stored, incoming).collect()) == ["b", "stays"]


def test_a_build_empties_a_namespace(spark, tmp_path):
    rows = spark.createDataFrame([("n" * 1200, "holdings")], "text string, namespace string")
    vectors = rows.selectExpr("'c' as chunk_id", "array(1f) as embedding", "'f' as fund", "namespace as file", "1L as row_count",
                              "array('x') as security_types", "array('x') as trade_types", "true as has_pl", "2023 as year", "text", "namespace")
    path = str(tmp_path / "index")
    vt.write_snapshot(vectors.unionAll(vectors.withColumn("namespace", F.lit("trades"))), path)
    vt.write_snapshot(vectors, path, ["holdings", "trades"])
    assert [(r["namespace"], len(r["text"])) for r in spark.read.schema(vt.SCHEMA).parquet(path).collect()] == [("holdings", 1200)]
    both = vectors.unionAll(vectors.withColumn("namespace", F.lit("trades")))
    shown = lambda: sorted((r["namespace"], len(r["text"])) for r in build_index.open_index(spark, str(tmp_path / "p")).collect())
    assert shown() == []
    assert vt.publish(both, str(tmp_path / "p"), ["holdings", "trades"]) == 1
    vt.publish(vectors.limit(0), str(tmp_path / "p"), ["trades"])
    assert shown() == [("holdings", 1200)]  # the other namespace stays at its version
    vt.publish(both, str(tmp_path / "p"), ["trades"])
    assert shown() == [("holdings", 1200), ("trades", 1200)]
    assert len(vt.retire(spark, str(tmp_path / "p"), keep=1)) == 1 and shown() == [("holdings", 1200), ("trades", 1200)]


def test_a_failed_build_leaves_the_old_index(spark, tmp_path):
    def broken(text):
        return F.raise_error(F.concat(F.lit("no model for "), text)).cast("array<float>")

    rows = [(f"01/08/23,Buy,Alpha,{k},1,1,1,1,01/08/23,S,N{k},T,C,P") for k in range(5)]
    header = "TradeDate,TradeTypeName,PortfolioName,Quantity,Price,Principal,TotalCash,AllocationCash,SettleDate,SecurityType,Name,Strategy1Name,CustodianName,Counterparty"
    (tmp_path / "t.csv").write_text("\n".join([header, *rows]))
    trades = ct.load_trades(spark, str(tmp_path / "t.csv"))
    path = str(tmp_path / "index")
    build_index.build(None, trades, path)
    before = [tuple(r) for r in build_index.open_index(spark, path).collect()]
    with pytest.raises(Exception, match="no model"):
        build_index.build(None, trades, path, embed=broken)
    with pytest.raises(Exception, match="no model"):
        vt.write_snapshot(vt.published(spark, path).withColumn("embedding", broken(F.col("text"))), str(tmp_path / "index"), ["trades"])
    assert [tuple(r) for r in build_index.open_index(spark, path).collect()] == before and len(before) == 1


def test_a_missing_text_has_no_vector(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    hook = vec.model_hook(lambda: type("M", (), {"encode": staticmethod(lambda texts: [[float(len(t))] for t in texts])})())
    assert [r[0] for r in df.select(hook("t")).collect()] == [[3.0], None, [0.0]]
