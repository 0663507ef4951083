import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fundweave.operators import chunks as ch
from fundweave.operators import packing
from fundweave.operators.packing import (
    NOTHING, add_overlap, after, chunk_starts, compose, fresh, pack, pack_pieces, stored_blocks, summarise)


def literal(tokens, limit):
    numbers, number, held, count = [], 0, 0, 0
    for t in tokens:
        if count and held + t > limit:
            number, held, count = number + 1, 0, 0
        numbers.append(number)
        held, count = held + t, count + 1
    return numbers


tokens_lists = st.lists(st.integers(0, 30), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(tokens_lists, st.integers(1, 40), st.integers(1, 12))
def test_blocks_follow_the_literal_walk(tokens, limit, size):
    held, base, numbers = fresh(limit), 0, []
    for start in range(0, len(tokens), size):
        block = np.asarray(tokens[start:start + size])
        starts = chunk_starts(block, limit, held)
        numbers += [base - 1 + int((starts <= i).sum()) for i in range(len(block))]
        summary = summarise(block, limit)
        held, opened = (int(x) for x in after(summary, held, limit))
        base += opened
        assert len(summary.reach) <= limit + 2
    assert numbers == literal(tokens, limit)


@settings(max_examples=300, deadline=None)
@given(st.lists(tokens_lists, min_size=1, max_size=6), st.integers(1, 40), st.randoms())
def test_summaries_compose_in_any_grouping(runs, limit, draw):
    parts = [summarise(np.asarray(run), limit) for run in runs]
    while len(parts) > 1:
        k = draw.randrange(len(parts) - 1)
        parts[k:k + 2] = [compose(parts[k], parts[k + 1], limit)]
    whole = summarise(np.asarray([t for run in runs for t in run]), limit)
    held = np.arange(limit + 3)
    for ours, theirs in zip(after(parts[0], held, limit), after(whole, held, limit)):
        assert ours.tolist() == theirs.tolist()
    assert len(parts[0].reach) <= limit + 2
    for ours, theirs in zip(after(compose(NOTHING, whole, limit), held, limit), after(whole, held, limit)):
        assert ours.tolist() == theirs.tolist()


def some_rows(spark, n=4000):
    """One fund holds most rows; texts have very different lengths."""
    return spark.range(n).select(
        F.lit("trades").alias("namespace"),
        F.when(F.col("id") % 10 < 7, "big").otherwise(F.concat(F.lit("small"), F.col("id") % 10)).alias("fund"),
        F.col("id").alias("row_ord"),
        F.repeat(F.lit("x"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int")).alias("text"),
        F.lit(None).cast("string").alias("security_type"),
        F.concat(F.lit("t"), F.col("id") % 9).alias("trade_type"),
        F.lit(None).cast("boolean").alias("pl_row"), F.lit(None).cast("int").alias("row_year"),
    )


def test_spark_packing_matches_the_literal_walk(spark):
    packed = ch.pack_rows(some_rows(spark), max_tokens=50, block_rows=37).toPandas().sort_values("row_ord")
    assert len(packed) == 4000
    for _, mine in packed.groupby("fund"):
        assert mine["chunk_no"].tolist() == literal(mine["n_tokens"].tolist(), 50)


def test_block_size_does_not_matter(spark):
    rows = some_rows(spark)
    frames = [
        ch.chunk_rows(rows, max_tokens=50, block_rows=size).orderBy("chunk_id").toPandas() for size in (11, 100_000)]
    assert frames[0].astype(str).equals(frames[1].astype(str))
    big = frames[0]
    assert big["row_count"].sum() == 4000
    assert ((big["n_tokens"] <= 50) | (big["row_count"] == 1)).all()
    assert max(len(t) for t in big["trade_types"]) > 5  # no type is left out


def test_rows_without_a_fund_are_left_out(spark):
    rows = some_rows(spark, 50).withColumn("fund", F.when(F.col("row_ord") > 3, F.col("fund")))
    assert pack(rows.withColumn("n_tokens", F.lit(1)), ["namespace", "fund"]).count() == 46


def test_oversize_and_empty_rows(spark):
    rows = spark.createDataFrame(
        [("f", i, t) for i, t in enumerate([700, 0, 3, 600, 600, 0, 0, 499, 1, 1])], "fund string, row_ord long, n_tokens int")
    for size in (1, 3, 100):
        packed = pack(rows, ["fund"], block_rows=size).orderBy("row_ord").collect()
        assert [r["chunk_no"] for r in packed] == literal([r["n_tokens"] for r in packed], 500)


def test_overlap_repeats_the_tail(spark):
    rows = spark.createDataFrame([("f", i, 200) for i in range(5)], "fund string, row_ord long, n_tokens int")
    packed = pack(rows, ["fund"])
    assert add_overlap(packed, ["fund"], 0) is packed
    found = sorted((r["chunk_no"], r["row_ord"]) for r in add_overlap(packed, ["fund"], 250).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 2), (1, 3), (2, 3), (2, 4)]


def test_the_tree_has_several_levels(spark, monkeypatch):
    """Groups of two partitions: what enters one comes down five levels, over funds of one and of many partitions."""
    monkeypatch.setattr(packing, "FAN", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = ch.pack_rows(some_rows(spark, 3000), max_tokens=70, block_rows=29).toPandas().sort_values("row_ord")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(packed) == 3000
    for _, mine in packed.groupby("fund"):
        assert mine["chunk_no"].tolist() == literal(mine["n_tokens"].tolist(), 70)


def test_many_interleaved_funds_share_few_blocks(spark):
    rows = spark.range(200_000).select(
        F.concat(F.lit("f"), F.col("id") % 20_000).alias("fund"), F.col("id").alias("row_ord"),
        (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).cast("int").alias("n_tokens"))
    blocks = stored_blocks(rows, ["fund"]).filter("rows IS NOT NULL")
    assert blocks.count() <= 2 * 200_000 / packing.BLOCK_ROWS + 20_000
    assert blocks.agg(F.sum(F.size("rows"))).first()[0] == 200_000
    whole = pack_pieces(rows, ["fund"])
    per_fund = whole.groupBy("fund").agg(F.sum(F.size("piece")).alias("n"), F.max("chunk_no").alias("last"), F.count("*").alias("chunks"))
    assert per_fund.filter("n <> 10 OR last + 1 <> chunks").count() == 0 and per_fund.count() == 20_000


def test_blocks_are_bounded_in_bytes(spark):
    rows = spark.range(300).select(F.lit("f").alias("fund"), F.col("id").alias("row_ord"), F.lit(1).alias("n_tokens"),
                                   F.repeat(F.lit("x"), 10_000).alias("text"))
    blocks = stored_blocks(rows, ["fund"], block_bytes=200_000).filter("rows IS NOT NULL")
    assert blocks.agg(F.max(F.size("rows"))).first()[0] <= 20
    packed = pack(rows, ["fund"], max_tokens=7, block_bytes=200_000).groupBy("chunk_no").count().collect()
    assert sorted(r["count"] for r in packed) == [6] + [7] * 42


def test_no_rows_give_no_chunks(spark):
    assert pack_pieces(some_rows(spark).withColumn("n_tokens", F.lit(3)).limit(0), ["namespace", "fund"]).count() == 0


def test_rows_are_sorted_once_and_blocks_never_shuffled(spark):
    df = pack_pieces(some_rows(spark).withColumn("n_tokens", F.lit(3)), ["namespace", "fund"], block_rows=64)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "rangepartitioning" not in plan  # the blocks are read, not made again
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("chunk_no" in line or "group#" in line for line in exchanges), exchanges
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_tokens_are_counted_once_a_row(spark):
    """What stands before the range sort is run twice: the sort samples it first."""
    from pyspark.sql import functions as F

    from fundweave.operators import chunks as ch

    rows = spark.range(400, numPartitions=4).select(
        F.lit("documents").alias("namespace"), (F.col("id") % 3).cast("string").alias("fund"), F.col("id").alias("row_ord"),
        F.repeat(F.lit("word "), (F.col("id") % 90).cast("int")).alias("text"), F.lit(None).cast("string").alias("security_type"),
        F.lit(None).cast("string").alias("trade_type"), F.lit(None).cast("boolean").alias("pl_row"), F.lit(None).cast("int").alias("row_year"))
    counted = spark.sparkContext.accumulator(0)

    def hook(text):
        @F.udf("int")
        def count(value):
            counted.add(1)
            return -(-len(value) // 4)

        return count(text)

    made = {(r["fund"], r["chunk_no"]): r["text"] for r in ch.chunk_rows(rows, count_tokens=hook, columns=["text"]).collect()}
    assert counted.value == 400
    assert made == {(r["fund"], r["chunk_no"]): r["text"] for r in ch.chunk_rows(rows).collect()}


def test_rows_are_rendered_after_the_sort_as_before_it(spark):
    from pyspark.sql import functions as F

    from fundweave.operators import chunks as ch

    trades = spark.range(300, numPartitions=3).select(
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("F"), F.col("id") % 4)).alias("PortfolioName"), F.col("id").alias("row_ord"),
        *(F.when(F.col("id") % 7 > 0, F.concat(F.lit(f"{name} "), F.col("id") % 5)).alias(name)
          for name in ("TradeTypeName", "Name", "SecurityType", "TradeDate", "Strategy1Name", "CustodianName", "Counterparty")),
        *(F.when(F.col("id") % 5 > 0, F.col("id") * 1234.5).alias(name) for name in ("Quantity", "Price", "TotalCash", "Principal")))
    late = {tuple(map(str, r)) for r in ch.build_chunks(None, trades).collect()}
    assert late and late == {tuple(map(str, r)) for r in ch.chunk_rows(ch.trades_rows(trades)).collect()}


def test_chunks_across_edges_do_not_read_whole_blocks(spark):
    """What lies across a block's edge is made of the few rows that a block holds apart."""
    import contextlib
    import io

    df = pack_pieces(some_rows(spark).withColumn("n_tokens", F.lit(3)), ["namespace", "fund"], block_rows=64)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    read = [line.split("FileScan parquet ")[1].split("]")[0] for line in out.getvalue().splitlines() if "FileScan parquet" in line and "tokens#" in line]
    assert sorted(("rows#" in columns, "head#" in columns) for columns in read) == [(False, True), (True, False)], read


def test_any_edge_gives_the_literal_walk(spark):
    """Rows without tokens, rows over the limit, chunks of many blocks and blocks of many chunks."""
    rows = spark.range(1500).select(
        F.when(F.col("id") % 13 == 0, "rare").when(F.col("id") % 701 == 0, F.concat(F.lit("one"), "id")).otherwise("big").alias("fund"),
        F.col("id").alias("row_ord"),
        F.get(F.array(*map(F.lit, [0, 0, 0, 1, 2, 5, 9, 10, 11, 40])), F.pmod(F.xxhash64("id"), F.lit(10)).cast("int")).alias("n_tokens"))
    for limit, size in ((10, 1), (10, 5), (10, 200), (60, 3), (3, 17)):
        whole = pack_pieces(rows, ["fund"], max_tokens=limit, block_rows=size)
        packed = whole.select("fund", "chunk_no", F.inline("piece")).toPandas().sort_values("row_ord")
        assert len(packed) == 1500 and whole.count() == len(packed[["fund", "chunk_no"]].drop_duplicates())
        for _, mine in packed.groupby("fund"):
            assert mine["chunk_no"].tolist() == literal(mine["n_tokens"].tolist(), limit)


def test_only_blocks_with_an_edge_hold_rows_twice(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, "big").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("fund"),
        F.col("id").alias("row_ord"), F.lit(3).alias("n_tokens"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        blocks = stored_blocks(rows, ["fund"], max_tokens=30, block_rows=100).filter("rows IS NOT NULL").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(blocks) == 1020
    last = max(b["fund"] for b in blocks)  # what comes after a partition is not known in it
    assert all(b["head"] is None and b["tail"] is None for b in blocks if b["fund"] not in ("big", last))
    for b in blocks:
        if b["fund"] == "big":
            assert b["head"] == b["rows"][:10] and b["tail"] == (None if b["ends"] else b["rows"][-10:])
