"""How an index is built and its matches described when the tables are large."""

import contextlib
import io

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from fundweave.functions import vectors as vec
from fundweave.operators import search
from fundweave.session import settings
from fundweave.sources import vector_table as vt


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_vectors_leave_a_task_as_one_arrow_array(spark):
    """Of a series of arrays Spark makes lists of objects before it makes an Arrow array."""
    texts = ["The fund, the FUND!", None, "", "Größe ÄB a-b"]
    embed = vec.hashed_counts(8)
    found = next(embed.func(iter([pa.array(texts)])))
    assert isinstance(found, pa.ListArray) and found.type == pa.list_(pa.float32()) and found.null_count == 1
    series = next(embed.func(iter([pd.Series(texts)])))
    assert found.to_pylist() == [None if v is None else v.tolist() for v in series]
    assert next(embed.func(iter([pa.array([None], pa.string())]))).to_pylist() == [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r["v"] for r in df.select("k", embed("t").alias("v")).orderBy("k").collect()] == found.to_pylist()


def test_texts_are_not_shuffled_for_few_matches(spark):
    """Spark takes what comes out of a search for as much as went in, unless the matches are stored first."""
    ids = spark.range(10_000_000).select(F.lit("holdings").alias("namespace"), F.col("id").alias("chunk_id"))
    vectors = ids.withColumn("text", F.concat(F.lit("text "), F.col("chunk_id").cast("string")))
    found = search.with_metadata(ids.filter("chunk_id % 2500000 = 7").withColumn("question_id", F.lit(1)), vectors)
    plan = _plan(found)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["text"] for r in found.collect()) == ["text 2500007", "text 5000007", "text 7", "text 7500007"]


def test_index_is_written_without_a_sort_by_namespace(spark, tmp_path, monkeypatch):
    """The sort would hold, and spill, the texts and vectors of a whole task."""
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(spark.conf.get(name)), write(self, *a, **b))[1])
    rows = spark.range(20).select(
        F.when(F.col("id") % 2 == 0, "holdings").otherwise("trades").alias("namespace"), F.lit("F").alias("fund"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("a b").alias("text"), F.lit(1).alias("row_count"),
        F.array(F.lit("x")).alias("security_types"), F.array(F.lit("y")).alias("trade_types"), F.lit(True).alias("has_pl"), F.lit(2020).alias("year"))
    before = spark.conf.get(name)
    vt.publish(vt.to_vectors(rows), str(tmp_path / "p"), ["holdings", "trades"])
    assert int(seen[0]) > 2 and spark.conf.get(name) == before
    assert {r["namespace"]: r["vectors"] for r in vt.table_stats(vt.published(spark, str(tmp_path / "p"))).collect()} == {
        "holdings": 10, "trades": 10, None: 20}


def test_settings_hold_for_the_jobs_inside_only(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), settings(spark, spark__sql__files__maxPartitionBytes=1 << 20):
        assert spark.conf.get(name) in ("1048576", "1048576b")
        1 / 0
    assert spark.conf.get(name) == before
    spark.conf.set(name, "2m")
    try:
        with settings(spark, spark__sql__files__maxPartitionBytes=1 << 20):
            assert spark.conf.get(name) in ("2m", "2097152b")
        assert spark.conf.get(name) in ("2m", "2097152b")
    finally:
        spark.conf.unset(name)


def test_settings_hold_where_the_default_was_set_by_name(spark):
    """Who sets a value back to what was read before says no more than Spark does; it is set back again."""
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, spark.conf.get(name))
    try:
        with settings(spark, spark__sql__files__maxPartitionBytes=1 << 20):
            assert spark.conf.get(name) in ("1048576", "1048576b")
        assert spark.conf.get(name) == "134217728b"
    finally:
        spark.conf.unset(name)


def test_rows_before_the_range_sort_are_not_sorted_for_a_join(spark, monkeypatch):
    """What stands before the range sort is run twice, the sort of a join with it."""
    from fundweave.operators import packing

    seen, write = [], DataFrameWriter.parquet

    def planned(self, *args, **options):
        self._df.collect()
        seen.append(self._df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", planned)
    rows = spark.range(4000).select(F.lit("f").alias("fund"), F.col("id").alias("row_ord"), (F.col("id") % 50).alias("k"), F.lit(3).alias("n_tokens"))
    names = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("name "), "id").alias("text"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = packing.pack_pieces(rows.join(names, "k"), ["fund"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "rangepartitioning" in seen[0] and "ShuffledHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]
    assert whole.select(F.inline("piece")).filter("text = concat('name ', k)").count() == 4000


def test_words_counted_together_are_those_counted_one_by_one(spark, monkeypatch):
    """Texts are counted in groups, and word by word where words hardly repeat themselves."""
    texts = ["The fund, the FUND!", None, "", "  \t\n", "Größe ÄB a-b İstanbul ΟΔΟΣ ΣΑΣ", "\x00a\x00 b", None, "x" * 5000, " a", "b "]
    many = texts * 30 + [" ".join(f"w{i}x{k}" for i in range(40)) for k in range(30)] + texts
    alone = [None if t is None else vec._counted(t, vec._Buckets(16)).tolist() for t in many]
    counted = []
    together = vec._counted_together
    monkeypatch.setattr(vec, "_counted_together", lambda group, buckets: counted.append(len(group)) or together(group, buckets))
    for chars in (1, 300, 10_000_000):
        monkeypatch.setattr(vec, "_GROUP_CHARS", chars)
        assert next(vec.hashed_counts(16).func(iter([pa.array(many)]))).to_pylist() == alone
    assert counted[-1] == sum(t is not None for t in many)
    assert next(vec.hashed_counts(16).func(iter([pa.array(["", " "])]))).to_pylist() == [[0.0] * 16] * 2
    assert next(vec.hashed_counts(16).func(iter([pa.array([], pa.string())]))).to_pylist() == []
