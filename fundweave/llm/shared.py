"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, as in tests, a temporary one, if Spark runs in one process;
    on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="fundweave-"))
    return _local[0]


#: Bounds of an Arrow batch while a table is stored, in rows and in bytes: texts of thousands of rows, or a few very long
#: ones, wait on both sides of the pipe to Python. A row beyond the bytes is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: later steps start there, whatever executors are lost. The session's
    bounds of a batch are lowered during the write, and are as they were afterwards."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = {name: spark.conf.get(name) for name in BATCH}
    for name, most in BATCH.items():
        own = was[name].removesuffix("b").removesuffix("B")
        spark.conf.set(name, min(most, int(own)) if own.isdigit() and int(own) > 0 else most)
    try:
        df.write.parquet(path)
    finally:
        for name, own in was.items():
            spark.conf.set(name, own)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
