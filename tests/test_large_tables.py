"""What must not gather in one task, or in one batch, when tables grow."""

import contextlib
import io
import tracemalloc

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fundweave.functions import vectors as vec
from fundweave.operators.packing import stored_blocks
from fundweave.workload import views


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_row_numbers_are_joined_without_a_shuffle_by_file(spark, tmp_path):
    for k, n in enumerate((5, 0, 7, 3)):
        spark.range(n).select((F.col("id") + 100 * k).alias("v")).coalesce(1).write.parquet(str(tmp_path / f"t/f{k}"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = views.in_file_order(spark.read.parquet(*(str(tmp_path / f"t/f{k}") for k in range(4))))
        plan = _plan(df)
        found = sorted((r["row_ord"], r["v"]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert found == list(enumerate([*range(5), *range(200, 207), *range(300, 303)]))


def test_words_of_a_batch_are_not_held_together(spark):
    texts = pd.Series([" ".join(f"w{k * 7 % 997}" for k in range(j, j + 3000)) for j in range(400)])
    embed = vec.hashed_counts().func
    next(embed(iter([texts[:1]])))
    tracemalloc.start()
    try:
        found = next(embed(iter([texts])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 400 and all(v.sum() == 3000 for v in found)
    assert peak < 8 * 1024 * 1024  # 0.6 MB of vectors, 6 MB of texts, 1.2 million words


def test_stored_blocks_lie_in_small_row_groups(spark, tmp_path):
    """A reader decodes a whole row group at once, nested rows and all."""
    rows = spark.range(100_000).select(
        F.lit("A").alias("fund"), F.col("id").alias("row_ord"), F.lit(90).alias("n_tokens"),
        F.concat(*(F.sha2(F.concat("id", F.lit(f"-{k}")), 256) for k in range(6))).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        blocks = stored_blocks(rows, ["fund"])
        files = [name.removeprefix("file://") for name in blocks.inputFiles()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    footers = [pq.ParquetFile(name).metadata for name in files]
    sizes = [f.row_group(k).total_byte_size for f in footers for k in range(f.num_row_groups)]
    assert sum(sizes) > 36 * 1024 * 1024  # 38 MB of texts in one partition
    assert max(sizes) < 20 * 1024 * 1024
