"""Cosine top-k of many questions against many stored vectors.

Exact search stores the questions as blocks of files in the shared folder. Every
scan task gathers its vectors into a bounded matrix, streams the blocks past it
in one pass and keeps the best few per question; a two-level merge leaves the
best of all tasks. The vectors are read once and never shuffled, the questions
never pass through the driver, and there is one plan for any number of either.

What a question demands of a vector (namespace, profit flag, any equality with
a metadata field) is a bit mask over the distinct demands of its block.

Approximate search stores vectors by signature cell, reads only the cells that
some question looks into, and divides crowded ones over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fundweave import fixed_values as fv
from fundweave.session import scratch_path
from fundweave.sources.shared_files import opened

SCORE_PLACES = 6
#: Questions of a stored block, bytes of the vectors a task holds at once, rows of a shard of a crowded cell.
BLOCK_QUESTIONS = 2_048
MATRIX_BYTES = 64 * 1024 * 1024
SHARD_ROWS = 20_000
_CELLS_AT_ONCE = 4_000_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), dim)


def _ranked(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best ``k`` per question: score, then namespace, then id."""
    found = found.sort_values(["q", "score", "namespace", "chunk_id"], ascending=[True, False, True, True])
    return found[found.groupby("q").cumcount() < k]


# --- demands as bit masks -----------------------------------------------------

class _Stored:
    """Vectors of one task, their metadata as dictionary codes."""

    def __init__(self, table: pa.Table, dim: int, fields: list[str]):
        self.ids = table["chunk_id"].to_numpy()
        self.vectors = _matrix(table["embedding"], dim)
        self.namespace = np.asarray(table["namespace"].to_pylist(), dtype=object)
        self.codes: dict[str, tuple[dict, np.ndarray]] = {}
        for name in fields:
            coded = table[f"_{name}"].combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            values = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
            self.codes[name] = values, coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)

    def bits(self, demands: list[tuple[str, str]]) -> np.ndarray:
        """Of each vector, a bit for each demand it meets. An absent value meets none."""
        out = np.zeros((len(self.ids), -(-len(demands) // 64)), np.uint64)
        for name, (values, codes) in self.codes.items():
            met = np.zeros((len(values) + 1, out.shape[1]), np.uint64)
            for k, (field, value) in enumerate(demands):
                if field == name and value in values:
                    met[values[value], k // 64] |= np.uint64(1 << k % 64)
            out |= met[codes]
        return out


class _Asked:
    """A block of questions: vectors, and for each the demands it makes as a mask."""

    def __init__(self, ids, matrix: np.ndarray, demands: list[tuple[str, str]], mask: np.ndarray):
        self.ids, self.matrix, self.demands, self.mask = ids, matrix, demands, mask
        self.norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))

    @classmethod
    def of(cls, table: pa.Table, dim: int) -> _Asked:
        """Vectors of another length are no questions. Checked here and not by a filter, which would move below a
        deduplication and embed every repeated question."""
        table = table.filter(pc.equal(pc.list_value_length(table["embedding"]), dim))
        wanted = [[(e["key"], e["value"]) for e in entries] for entries in table["demands"].to_pylist()]
        demands = sorted({pair for pairs in wanted for pair in pairs})
        place = {pair: k for k, pair in enumerate(demands)}
        mask = np.zeros((len(wanted), -(-len(demands) // 64)), np.uint64)
        for row, pairs in enumerate(wanted):
            for pair in pairs:
                mask[row, place[pair] // 64] |= np.uint64(1 << place[pair] % 64)
        return cls(table["question_id"], _matrix(table["embedding"], dim), demands, mask)


def _demands(questions: DataFrame, fields: list[str]) -> Column:
    """Field and value of each demand as a sorted map: namespace, profit flag, and the ``filters`` of the question."""
    own = F.create_map(F.lit("namespace"), F.col("namespace"), F.lit("has_pl"), F.when(F.col("need_pl"), F.lit("true")))
    if "filters" in questions.columns:
        known = F.array(*map(F.lit, fields))
        foreign = F.filter(F.map_keys("filters"), lambda name: ~F.array_contains(known, name))
        checked = F.when(F.size(foreign) > 0, F.raise_error(F.concat(F.lit("no such field to filter by: "), F.get(foreign, F.lit(0)))).cast("map<string,string>"))
        # A question may also filter by namespace or flag; where it says so twice, both count.
        entries = F.concat(F.map_entries(own), F.coalesce(F.map_entries(F.coalesce(checked, F.col("filters"))), F.array()))
    else:
        entries = F.map_entries(own)
    return F.array_sort(F.array_distinct(F.filter(entries, lambda e: e["value"].isNotNull())))


def _pack(dim: int, size: int, schema: pa.Schema):
    """Questions as rows of a block each: ids, matrix, demands, masks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                asked = _Asked.of(pa.Table.from_batches([batch.slice(start, size)]), dim)
                if len(asked.matrix):
                    yield pa.RecordBatch.from_pylist([{
                        "ids": asked.ids.to_pylist(), "matrix": asked.matrix.tobytes(), "fields": [f for f, _ in asked.demands],
                        "values": [v for _, v in asked.demands], "mask": asked.mask.tobytes()}], schema)

    return pack


def _store_questions(questions: DataFrame, dim: int, fields: list[str]) -> list[str]:
    """Writes the questions as blocks below the shared folder; the files' names. Questions that demand the same come
    together, so a block has few distinct demands."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = questions.sparkSession
    asked = questions.select("question_id", F.col("embedding").cast("array<double>").alias("embedding"), _demands(questions, fields).alias("demands"))
    kind = questions.schema["question_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("matrix", T.BinaryType()), T.StructField("fields", T.ArrayType(T.StringType())),
                           T.StructField("values", T.ArrayType(T.StringType())), T.StructField("mask", T.BinaryType())])
    path = scratch_path(spark, "questions")
    packed = asked.sortWithinPartitions("demands").mapInArrow(_pack(dim, BLOCK_QUESTIONS, to_arrow_schema(schema)), schema)
    packed.write.option("parquet.block.size", 8 * 1024 * 1024).parquet(path)
    return spark.read.schema(schema).parquet(path).inputFiles()


def _stored_questions(files: list[str], dim: int) -> Iterator[_Asked]:
    """The blocks, one at a time, from any file system that Arrow reads."""
    for name in files:
        with opened(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1):
                for row in batch.to_pylist():
                    n = len(row["ids"])
                    yield _Asked(pa.chunked_array([batch.column("ids").flatten()]), np.frombuffer(row["matrix"]).reshape(n, dim),
                                 list(zip(row["fields"], row["values"])), np.frombuffer(row["mask"], np.uint64).reshape(n, -1))


# --- scores -------------------------------------------------------------------

class _Best:
    """The best few stored vectors of each question of a block."""

    def __init__(self, asked: _Asked, k: int, positive_only: bool):
        self.asked, self.k, self.positive_only = asked, k, positive_only
        self.floor = np.full(len(asked.norm), -np.inf)
        self.found: list[pd.DataFrame] = []

    def offer(self, stored: _Stored) -> None:
        bits = stored.bits(self.asked.demands)
        rows = max(1, _CELLS_AT_ONCE // max(1, len(self.asked.norm)))
        for start in range(0, len(stored.ids), rows):
            part = slice(start, start + rows)
            self._offer(stored.ids[part], stored.vectors[part], stored.namespace[part], bits[part])

    def _offer(self, ids, vectors, namespace, bits) -> None:
        asked = self.asked
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = (asked.matrix @ vectors.T) / (asked.norm[:, None] * norm[None, :])
        scores = np.round(scores, SCORE_PLACES)
        allowed = np.isfinite(scores)
        for word in range(asked.mask.shape[1]):
            mask = asked.mask[:, word, None]
            if mask.any():
                allowed &= (bits[None, :, word] & mask) == mask
        if self.positive_only:
            allowed &= scores > 0
        scores[~allowed] = -np.inf
        floor = self.floor
        if len(ids) > self.k:
            cut = len(ids) - self.k
            floor = np.maximum(floor, np.partition(scores, cut, axis=1)[:, cut])
        q, v = np.nonzero((scores >= floor[:, None]) & allowed)
        if not len(q):
            return
        self.found.append(pd.DataFrame({
            "q": q, "score": scores[q, v], "namespace": namespace[v], "chunk_id": ids[v],
        }))
        kept = _ranked(pd.concat(self.found), self.k)
        self.found = [kept]
        full = kept.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.floor[full.index] = full["min"]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """The matches found."""
        if not self.found:
            return pa.RecordBatch.from_pylist([], schema)
        kept = self.found[0]
        ids = self.asked.ids.combine_chunks().take(pa.array(kept["q"].to_numpy()))
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        values = [ids, *(pa.array(np.asarray(kept[name]), schema.field(name).type) for name in ("namespace", "chunk_id", "score"))]
        return pa.RecordBatch.from_arrays(values, schema=schema)


def having(vectors: DataFrame, **fields) -> DataFrame:
    """Stored vectors whose metadata equal all given values; an absent value equals none."""
    for name, value in fields.items():
        vectors = vectors.filter(F.col(name) == F.lit(value))
    return vectors


def _stored_columns(vectors: DataFrame, dim: int, fields: list[str], *more: str) -> DataFrame:
    """What a search reads of stored vectors of the right length; others can match nothing."""
    return vectors.filter(F.size("embedding") == dim).select(
        "namespace", "chunk_id", "embedding", *(F.col(f).cast("string").alias(f"_{f}") for f in fields), *more)


def _scan(files: list[str], k: int, dim: int, fields: list[str], positive_only: bool, schema: pa.Schema) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], max(1, MATRIX_BYTES // (8 * dim))

        def matched() -> Iterator[pa.RecordBatch]:
            stored = _Stored(pa.Table.from_batches(held), dim, fields)
            held.clear()
            for asked in _stored_questions(files, dim):
                best = _Best(asked, k, positive_only)
                best.offer(stored)
                yield best.batch(schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from matched()
        if held:
            yield from matched()

    return search


def _match_schema(vectors: DataFrame, questions: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("question_id", questions.schema["question_id"].dataType),
        T.StructField("namespace", T.StringType()),
        T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def best_per_question(matches: DataFrame, k: int) -> DataFrame:
    """The k best; each task drops what is not among its own k best before the shuffle."""
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "namespace", "chunk_id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _fields(vectors: DataFrame, filter_fields: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(["namespace", "has_pl", *filter_fields]))


def top_k(
    vectors: DataFrame,
    questions: DataFrame,
    k: int | None = None,
    dim: int = fv.VECTOR_DIM,
    positive_only: bool = False,
    filter_fields: tuple[str, ...] = (),
) -> DataFrame:
    """``question_id, namespace, chunk_id, score, rank`` of the ``k`` best matches, exactly.

    ``questions``: question_id, embedding, namespace (null: both), need_pl, and maybe ``filters``, a map of metadata
    fields among ``filter_fields`` to the text of the value that a vector must have. ``vectors``: namespace, chunk_id,
    embedding, has_pl and those fields; a row without a value never answers a question that needs one. Scores are
    compared at six places, so equal vectors tie on every engine and the id decides.

    The questions are stored when this is called, in the folder of ``spark.checkpoint.dir``; the tasks read them there
    (local or mounted folders, hdfs, s3, gs, abfs). The search itself is left to the caller's job.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    k = k or fv.TOP_K
    fields = _fields(vectors, filter_fields)
    files = _store_questions(questions, dim, fields)
    schema = _match_schema(vectors, questions)
    found = _stored_columns(vectors, dim, fields).mapInArrow(_scan(files, k, dim, fields, positive_only, to_arrow_schema(schema)), schema)
    return best_per_question(found, k)


def with_metadata(matches: DataFrame, vectors: DataFrame) -> DataFrame:
    """Fund, source and stored text of the few matches that are left.

    The matches are stored when this is called. So Spark knows how many there are before it plans the join: where they are
    few, they go to the vectors, whose texts are not shuffled.
    """
    spark, path = matches.sparkSession, scratch_path(matches.sparkSession, "matches")
    matches.write.parquet(path)
    matches = spark.read.schema(matches.schema).parquet(path)
    wanted = [c for c in ("fund", "file", "has_pl", "text") if c in vectors.columns]
    return matches.join(vectors.select("namespace", "chunk_id", *wanted), ["namespace", "chunk_id"])


# --- approximate ------------------------------------------------------------

def planes(dim: int, bits: int) -> np.ndarray:
    """Normal vectors of the planes that divide the cells. A component is a sum of four whole numbers, each four hex
    digits of the md5 of ``dimension:plane``, less their mean: nearly normal, and the same in every engine."""
    import hashlib

    def component(d: int, b: int) -> int:
        digest = hashlib.md5(f"{d}:{b}".encode()).hexdigest()
        return sum(int(digest[i:i + 4], 16) for i in range(0, 16, 4)) - 131_070

    return np.array([[component(d, b) for b in range(bits)] for d in range(dim)], np.float64)


def cells(embedding: Column, dim: int, bits: int, probes: int = 1) -> Column:
    """The cell of a vector, followed by the ``probes - 1`` cells next nearest to it, by the sum of the planes' distances;
    null for a vector of another length."""

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        normal, weights = planes(dim, bits), 1 << np.arange(bits)
        flips = (np.arange(1 << bits) >> np.arange(bits)[:, None] & 1).astype(float)  # planes x changes of sides
        for batch in batches:
            fits = np.array([v is not None and len(v) == dim for v in batch], bool)
            out = [None] * len(batch)
            if fits.any():
                sides = np.stack([np.asarray(v, np.float64) for v in batch[fits]]) @ normal
                home = (sides > 0) @ weights
                found = np.empty((len(home), probes), np.int32)
                for i in range(0, len(home), 64):  # all cells of a few vectors at once
                    far = np.abs(sides[i:i + 64]) @ flips
                    nearest = np.argsort(far, axis=1, kind="stable")[:, :probes]
                    found[i:i + 64] = home[i:i + 64, None] ^ nearest
                for place, row in zip(np.flatnonzero(fits), found):
                    out[place] = row
            yield pd.Series(out, dtype=object)

    return find(embedding)


def _checked(bits: int, probes: int = 1) -> None:
    if not 1 <= bits <= 16:
        raise ValueError("bits must lie between 1 and 16: a row per cell is broadcast")
    if not 1 <= probes <= 1 << bits:
        raise ValueError("probes must lie between 1 and the number of cells")


def with_cells(vectors: DataFrame, dim: int = fv.VECTOR_DIM, bits: int = 8) -> DataFrame:
    """Stored vectors with their ``cell``, to be written partitioned by namespace and cell."""
    _checked(bits)
    return vectors.filter(F.size("embedding") == dim).withColumn("cell", F.get(cells(F.col("embedding"), dim, bits), F.lit(0)))


def _cell_search(k: int, dim: int, fields: list[str], schema: pa.Schema):
    def search(stored: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(stored) or not len(asked):
            return schema.empty_table()
        best = _Best(_Asked.of(asked, dim), k, False)
        best.offer(_Stored(stored, dim, fields))
        return pa.Table.from_batches([best.batch(schema)])

    return search


def _by_shards(stored: DataFrame, asked: DataFrame, k: int, dim: int, fields: list[str], schema: T.StructType) -> DataFrame:
    """Candidates from vectors and questions of the same ``cell``.

    Both sides say into how many shards their cell is divided (``v_shards`` of
    vectors, ``q_shards`` of questions). Every pair of shards is a task of its
    own, so neither a crowded cell nor a much-asked one gathers in one place.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    v_shards, q_shards = F.col("v_shards"), F.col("q_shards")
    stored = stored.withColumns({
        "v": F.pmod(F.xxhash64("namespace", "chunk_id"), v_shards).cast("int"),
        "q": F.explode(F.sequence(F.lit(0), q_shards - 1)),
    }).drop("v_shards", "q_shards")
    asked = asked.withColumns({
        "q": F.pmod(F.xxhash64("question_id"), q_shards).cast("int"),
        "v": F.explode(F.sequence(F.lit(0), v_shards - 1)),
    }).drop("v_shards", "q_shards")
    return stored.groupBy("cell", "v", "q").cogroup(asked.groupBy("cell", "v", "q")).applyInArrow(
        _cell_search(k, dim, fields, to_arrow_schema(schema)), schema)


def _cell_shards(df: DataFrame, name: str, rows: int) -> DataFrame:
    return df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))


def approximate_top_k(
    stored: DataFrame,
    questions: DataFrame,
    k: int | None = None,
    dim: int = fv.VECTOR_DIM,
    bits: int = 8,
    probes: int = 12,
    cell_rows: int = SHARD_ROWS,
    filter_fields: tuple[str, ...] = (),
) -> DataFrame:
    """Like :func:`top_k`, but a question only sees the vectors of the ``probes`` cells it looks into.

    ``stored`` has the ``cell`` of each vector (:func:`with_cells` with the same ``bits``); where it is a table
    partitioned by namespace and cell, only partitions that some question looks into are read. There are ``2 ** bits``
    cells; more bits make them smaller, more probes the result closer to exact, and as many probes as cells exact.
    """
    _checked(bits, probes)
    spark = stored.sparkSession
    k = k or fv.TOP_K
    fields = _fields(stored, filter_fields)
    schema = _match_schema(stored, questions)
    asked = questions.filter(F.size("embedding") == dim).select(
        "question_id", F.col("embedding").cast("array<double>").alias("embedding"), _demands(questions, fields).alias("demands"),
        "namespace", F.explode(cells(F.col("embedding"), dim, bits, probes)).alias("cell"))
    path = scratch_path(spark, "probes")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    wanted = asked.agg(F.collect_set("cell").alias("cells"), F.collect_set("namespace").alias("names"),
                       F.count_if(F.col("namespace").isNull()).alias("open")).first()  # at most 2 ** bits cells
    stored = stored.filter(F.col("cell").isin(wanted["cells"]))
    if not wanted["open"]:
        stored = stored.filter(F.col("namespace").isin(wanted["names"]))
    stored = _stored_columns(stored, dim, fields, "cell")
    asked = asked.drop("namespace")
    sizes = F.broadcast(  # at most 2 ** bits rows
        _cell_shards(stored, "v_shards", cell_rows).join(_cell_shards(asked, "q_shards", cell_rows), "cell"))
    found = _by_shards(stored.join(sizes, "cell"), asked.join(sizes, "cell"), k, dim, fields, schema)
    return best_per_question(found, k)
