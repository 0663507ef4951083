"""Dropped CSV files renew the stored vectors of the funds they contain.

Each micro-batch writes its own ``version`` folder, named after the batch
number, so a repeated batch replaces itself and nothing that is read is written
over. A reader takes the newest version of every fund.

A fund's newest drop replaces it, unless the rows of all drops are kept (``rows_path``): then a drop adds its rows to
those that the fund has, and the fund is packed anew from all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fundweave.functions.vectors import Embedder
from fundweave.operators import chunks as ch
from fundweave.sources import csv_tables as ct, vector_table as vt

_ROWS: dict[str, tuple[Callable, Callable]] = {
    "holdings": (ct.clean_holdings, ch.holdings_rows),
    "trades": (ct.clean_trades, ch.trades_rows),
}


_FUND = "PortfolioName"
_SHARES = 64  # folders of a drop's rows, by fund: a later drop reads only those of its own funds


def _with_earlier(batch: DataFrame, number: int, rows_path: str) -> DataFrame:
    """Keeps the rows of a drop, as they came, and gives all rows of its funds from this drop and those before.

    A repeated drop writes the same folders again. Rows without a fund count as one fund.
    """
    kept = batch.withColumns({
        "_line": F.monotonically_increasing_id(), "_drop": F.lit(number).cast("bigint"),
        "_share": F.pmod(F.xxhash64(_FUND), F.lit(_SHARES)).cast("int")})
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_drop", "_share").parquet(rows_path)
    stored = batch.sparkSession.read.schema(kept.schema).parquet(rows_path).where(F.col("_drop") <= number)
    now = stored.where(F.col("_drop") == number).select(F.col(_FUND).alias("_fund"), F.col("_share").alias("_in")).distinct()
    return stored.join(now, (F.col("_share") == F.col("_in")) & F.col(_FUND).eqNullSafe(F.col("_fund")), "left_semi").drop("_share")


def _renew(kind: str, index_path: str, embed: Embedder | None, packing: dict, rows_path: str | None) -> Callable[[DataFrame, int], None]:
    clean, to_rows = _ROWS[kind]

    def write(batch: DataFrame, number: int) -> None:
        place = [F.col("_file").alias("file"), F.col("_split").alias("split_start")]
        if rows_path is None:
            position = F.struct(*place, F.monotonically_increasing_id().alias("line"))
        else:
            if batch.isEmpty():
                return
            batch = _with_earlier(batch, number, rows_path)
            position = F.struct(F.col("_drop").alias("drop"), *place, F.col("_line").alias("line"))
        raw = batch.withColumn("row_ord", position).drop("_file", "_split", "_line", "_drop")
        rows = to_rows(clean(raw))
        vectors = vt.to_vectors(ch.chunk_rows(rows, **packing), embed)
        (
            vectors.withColumn("version", F.lit(number).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("version", "namespace").parquet(index_path)
        )

    return write


def start(
    spark: SparkSession,
    folder: str,
    kind: str,
    columns: list[str],
    index_path: str,
    checkpoint: str,
    embed: Embedder | None = None,
    rows_path: str | None = None,
    **packing,
) -> StreamingQuery:
    """Work off every file now in ``folder`` and stop; call again for later drops.

    With ``rows_path``, a folder of its own, drops add up; without, a fund's newest drop replaces it.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    arriving = (
        spark.readStream.schema(schema).options(header=True, enforceSchema=False, emptyValue="", escape='"').csv(folder)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    )
    return (
        arriving.writeStream.foreachBatch(_renew(kind, index_path, embed, packing, rows_path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current(spark: SparkSession, index_path: str) -> DataFrame:
    """The newest vectors of every fund."""
    schema = T.StructType(vt.SCHEMA.fields + [T.StructField("version", T.LongType())])
    stored = spark.read.schema(schema).parquet(index_path)
    newest = stored.groupBy("namespace", "fund").agg(F.max("version").alias("version"))
    return stored.join(newest, ["namespace", "fund", "version"], "left_semi").drop("version")


def retire(spark: SparkSession, index_path: str) -> list[int]:
    """Deletes the versions that hold no fund's newest vectors; their numbers. To be called while nobody reads them."""
    stored = spark.read.schema(T.StructType(vt.SCHEMA.fields + [T.StructField("version", T.LongType())])).parquet(index_path)
    versions = stored.groupBy("namespace", "fund").agg(F.max("version").alias("newest"))
    used = {r[0] for r in versions.select("newest").distinct().collect()}  # as many rows as there were drops, at most
    old = sorted({r[0] for r in stored.select("version").distinct().collect()} - used)
    for version in old:
        vt._remove(spark, f"{index_path.rstrip('/')}/version={version}")
    return old
