"""The stored vector table: create, replace, delete, count.

Snapshots are plain DataFrames. A published table is a new folder for each build
and a row of pointers for each namespace; a folder that is being read is never
written over.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from fundweave import fixed_values as fv
from fundweave.functions import text as tx
from fundweave.functions.vectors import Embedder, hashed_counts, wrong_length
from fundweave.operators import search
from fundweave.session import settings

KEYS = ["namespace", "chunk_id"]

SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("fund", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("security_types", T.ArrayType(T.StringType())),
    T.StructField("trade_types", T.ArrayType(T.StringType())),
    T.StructField("has_pl", T.BooleanType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("namespace", T.StringType()),
])


def create_table(spark: SparkSession, name: str, location: str | None = None, dim: int = fv.VECTOR_DIM) -> DataFrame:
    """Create the table unless it is there, check its dimension, and return it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMA.fields)
    where = f"LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (namespace) {where} "
        f"TBLPROPERTIES ('vector.dimension'='{dim}', 'vector.metric'='{fv.VECTOR_METRIC}')"
    )
    found = spark.sql(f"SHOW TBLPROPERTIES {name} ('vector.dimension')").first()["value"]
    if found != str(dim):
        raise ValueError(f"table {name} holds vectors of dimension {found}, not {dim}")
    return spark.table(name)


def to_vectors(chunks: DataFrame, embed: Embedder | None = None, dim: int = fv.VECTOR_DIM,
               text_chars: int | None = None) -> DataFrame:
    """Chunks to stored rows, each with its whole text, or the first ``text_chars`` characters of it."""
    embed = embed or hashed_counts(dim)
    return chunks.select(
        "chunk_id", embed(F.col("text")).alias("embedding"), "fund",
        F.col("namespace").alias("file"), F.col("row_count").cast("long").alias("row_count"),
        "security_types", "trade_types", "has_pl", "year",
        tx.stored_text(F.col("text"), text_chars).alias("text"), "namespace",
    )


def misfits(vectors: DataFrame, dim: int = fv.VECTOR_DIM) -> DataFrame:
    """Rows whose vector is missing or of another length."""
    return vectors.filter(wrong_length(F.col("embedding"), dim))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot: incoming rows win over stored ones with the same key.

    Of incoming rows with the same key one stays, the greatest by its columns.
    """
    others = [c for c in incoming.columns if c not in KEYS]
    one = incoming.groupBy(*KEYS).agg(F.max(F.struct(*others)).alias("_one"))
    incoming = one.select(*KEYS, "_one.*").select(*incoming.columns)
    return stored.join(incoming.select(*KEYS), KEYS, "left_anti").unionByName(incoming)


def delete_namespace(stored: DataFrame, namespace: str) -> DataFrame:
    return stored.filter(F.col("namespace") != namespace)


def table_stats(stored: DataFrame) -> DataFrame:
    """Vectors and dimension per namespace; the row without a namespace is the total."""
    return stored.rollup("namespace").agg(
        F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimension"))


def write_snapshot(vectors: DataFrame, path: str, namespaces: list[str] | None = None) -> None:
    """Replaces the namespaces that occur in ``vectors``; those named that don't occur are empty afterwards; others stay as
    they are. Nothing is removed before the new rows are written. For a table that has readers, see :func:`publish`."""
    spark = vectors.sparkSession
    named = list(namespaces or [])
    seen = Observation()
    counts = [F.count_if(F.col("namespace") == name).alias(f"n{i}") for i, name in enumerate(named)]
    watched = vectors.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    (
        watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("namespace").parquet(path)
    )
    for i, name in enumerate(named):
        if not seen.get[f"n{i}"]:
            _remove(spark, f"{path.rstrip('/')}/namespace={name}")


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# --- published versions --------------------------------------------------------

_POINTERS = "version long, namespace string, folder string"
#: Bytes of stored blocks that a task makes vectors of: decoded, with texts and vectors, they are some thirty times as many.
_SPLIT_BYTES = 16 * 1024 * 1024


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """All pointers, newest first; a row for each namespace of each build."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/pointers")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    rows = spark.read.schema(_POINTERS).parquet(folder.toString()).collect()
    return sorted((tuple(r) for r in rows), reverse=True)


def publish(vectors: DataFrame, path: str, namespaces: list[str]) -> int:
    """Writes the named namespaces of ``vectors`` as a new version below ``path`` and then switches to it.

    The rows go to a folder of their own; one small file of pointers, written last, makes them the current ones. If
    anything fails before, readers keep what they have. Other namespaces stay at their version, a named one without rows
    is empty. One build at a time may publish to a path. Returns the version.

    A task keeps a file open for each namespace, so its texts and vectors need no sort by it.
    """
    spark = vectors.sparkSession
    before = _pointers(spark, path)
    version = before[0][0] + 1 if before else 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters=len(namespaces) + 1, spark__sql__files__maxPartitionBytes=_SPLIT_BYTES):
        vectors.filter(F.col("namespace").isin(namespaces)).write.partitionBy("namespace").parquet(f"{path.rstrip('/')}/{folder}")
    pointer = spark.createDataFrame([(version, name, folder) for name in namespaces], _POINTERS).coalesce(1)
    pointer.write.mode("append").parquet(f"{path.rstrip('/')}/pointers")
    return version


def published(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """The current rows of every namespace. A filter on the namespace reads that folder only."""
    newest: dict[str, str] = {}
    for _, name, folder in _pointers(spark, path):
        newest.setdefault(name, folder)
    parts = [spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{folder}").filter(F.col("namespace") == name)
             for name, folder in sorted(newest.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the folders of all but the newest ``keep`` versions of every namespace; the deleted ones. Readers of the
    kept versions are not disturbed."""
    kept: dict[str, list[str]] = {}
    for _, name, folder in _pointers(spark, path):
        if len(kept.setdefault(name, [])) < keep:
            kept[name].append(folder)
    used = {folder for folders in kept.values() for folder in folders}
    old = sorted({folder for _, _, folder in _pointers(spark, path)} - used)
    for folder in old:
        _remove(spark, f"{path.rstrip('/')}/{folder}")
    return old


def write_cells(vectors: DataFrame, path: str, dim: int = fv.VECTOR_DIM, bits: int = 8) -> None:
    """Stores vectors by namespace and signature cell, for approximate search; replaces what is there. Cells are brought
    together for few files; adaptive execution splits crowded ones."""
    placed = search.with_cells(vectors, dim, bits).hint("rebalance", "namespace", "cell")  # few files, crowded cells split
    placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "namespace", "cell").parquet(path)


def open_cells(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """The stored vectors with their cell. Vectors of a wrong length are not in it."""
    fields = [f for f in schema.fields if f.name != "namespace"]
    return spark.read.schema(T.StructType([*fields, schema["namespace"], T.StructField("cell", T.IntegerType())])).parquet(path)


# --- changed sources ---------------------------------------------------------

#: A prime below 2^31, so that a product of two remainders fits a long, and two bases.
_PRIME, _BASES = 2_147_483_647, (1_103_515_245, 1_566_083_941)
_PIECE_ROWS = 65_536


def _chained(parts: Column) -> Column:
    """Ordered parts (n, a, b, pa, pb) to one: the hash of a sequence is the earlier one times a power of the base, by the
    later one's length, plus the later one. So any division of a sequence gives the same."""
    def following(was: Column, part: Column) -> Column:
        step = [F.pmod(was[h] * part[p] + part[h], F.lit(_PRIME)).alias(h) for h, p in (("a", "pa"), ("b", "pb"))]
        powers = [F.pmod(was[p] * part[p], F.lit(_PRIME)).alias(p) for p in ("pa", "pb")]
        return F.struct((was["n"] + part["n"]).alias("n"), *step, *powers)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("a"), zero.alias("b"), one.alias("pa"), one.alias("pb"))
    return F.aggregate(parts, start, following)


def _by_position(rows: DataFrame) -> DataFrame:
    """``namespace, fund, rows, mark``: for each file, the hash of the fund's rows in it, in their order.

    Hashes of short pieces of a split are chained to files, pieces being runs of lines, so the place of split borders
    and what other funds or files hold make no difference. A file counts by its name, not by its folder.
    """
    content = [F.col(c) for c in rows.columns if c not in ("namespace", "fund", "row_ord")]
    line, split = F.col("row_ord.line"), F.col("row_ord.split_start")
    piece = F.struct(split.alias("split"), F.floor(line / _PIECE_ROWS).alias("at"))
    one = F.lit(1).cast("long")
    hashed = F.struct(
        line.alias("line"), one.alias("n"), *(F.pmod(F.xxhash64(F.lit(base), *content), F.lit(_PRIME)).alias(h) for h, base in zip("ab", _BASES)),
        *(F.lit(base).cast("long").alias(p) for p, base in zip(("pa", "pb"), _BASES)))
    keys = ["namespace", "fund", "_file"]
    pieces = rows.withColumns({"_file": F.col("row_ord.file"), "_piece": piece, "_row": hashed}).groupBy(*keys, "_piece").agg(
        _chained(F.sort_array(F.collect_list("_row"))).alias("_chain"))
    files = pieces.groupBy(*keys).agg(_chained(F.transform(
        F.sort_array(F.collect_list(F.struct("_piece", "_chain"))), lambda p: p["_chain"])).alias("_chain"))
    name = F.element_at(F.split("_file", "/"), -1)
    return files.select("namespace", "fund", F.col("_chain.n").alias("_n"), F.xxhash64(name, "_chain").alias("_mark"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """Count and content hash per fund. Only the content and order of its own rows count; where order is a place in a
    file, so does the file's name, but neither other files or funds, nor how files are split or which folder they are in."""
    if "row_ord" in rows.columns and isinstance(rows.schema["row_ord"].dataType, T.StructType):
        marks = _by_position(rows)
    else:
        content = [F.col(c) for c in rows.columns if c not in ("namespace", "fund")]
        marks = rows.select("namespace", "fund", F.lit(1).cast("long").alias("_n"), F.xxhash64(*content).alias("_mark"))
    return marks.groupBy("namespace", "fund").agg(
        F.sum("_n").alias("rows"), F.bit_xor("_mark").alias("mark"),
        F.sum(F.col("_mark").cast("decimal(38,0)")).alias("total"),
    )


def changed_funds(before: DataFrame, after: DataFrame) -> DataFrame:
    """Funds that are new, gone or different, from two fingerprint tables."""
    old = before.select("namespace", "fund", F.struct("rows", "mark", "total").alias("was"))
    new = after.select("namespace", "fund", F.struct("rows", "mark", "total").alias("now"))
    return (
        old.join(new, ["namespace", "fund"], "full")
        .filter(~F.col("was").eqNullSafe(F.col("now")))
        .select("namespace", "fund", F.when(F.col("was").isNull(), "new")
                .when(F.col("now").isNull(), "gone").otherwise("changed").alias("change"))
    )


def replace_funds(stored: DataFrame, funds: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Drops every vector of ``funds``, also those no longer produced, then adds the rebuilt ones."""
    return stored.join(funds.select("namespace", "fund"), ["namespace", "fund"], "left_anti").unionByName(rebuilt)
