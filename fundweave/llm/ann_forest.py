"""Approximate nearest neighbours by inner product: a forest of random-projection trees with a shared priority queue."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundweave.llm import shared

#: Rows that the trees are fitted on, at most; every row is then put into a leaf of each tree.
SAMPLE = 8192
TREES = 4
#: Rows that a leaf is meant to have, and levels of a tree, at most: a tree is of bounded size, leaves are cut to blocks.
LEAF_ROWS, LEVELS = 2048, 10
#: Rows and queries that meet in one group, about.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Leaves of a query that are searched first. Of the others only what is as near as their k-th best goes on.
FIRST_VISITS = 4
#: Queries whose exact neighbours tell how far the queue has to be followed.
PROBES = 32


@dataclass
class Forest:
    """For each tree a direction and a threshold for each inner node, in the order of a heap; leaves are numbered from the
    left. `longest` is the largest norm: vectors get a coordinate that makes all norms equal to it, so that the largest
    inner product is the smallest distance."""

    directions: np.ndarray  # trees x nodes x (dimension + 1)
    thresholds: np.ndarray  # trees x nodes
    levels: int
    longest: float


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def grow(sample: np.ndarray, longest: float, trees: int, levels: int, seed: int = 3) -> Forest:
    """Each node splits its part of the sample at the median, along the line between two of its vectors."""
    points = _lifted(sample, longest)
    draw = np.random.default_rng(seed)
    nodes = (1 << levels) - 1
    directions, thresholds = np.zeros((trees, nodes, points.shape[1])), np.zeros((trees, nodes))
    for tree in range(trees):
        parts = [np.arange(len(points))]
        for node in range(nodes):
            own = parts[node]
            line = np.zeros(points.shape[1])
            if len(own) > 1:
                a, b = draw.choice(own, 2, replace=False)
                line = points[a] - points[b]
            if not line.any():
                line = draw.normal(size=points.shape[1])
            directions[tree, node] = line / np.linalg.norm(line)
            side = points[own] @ directions[tree, node]
            thresholds[tree, node] = np.median(side) if len(own) else 0
            parts += [own[side < thresholds[tree, node]], own[side >= thresholds[tree, node]]]
    return Forest(directions, thresholds, levels, longest)


def leaves(x: np.ndarray, forest: Forest) -> np.ndarray:
    """The leaf of each vector in each tree (vectors x trees)."""
    points = _lifted(x, forest.longest)
    out = np.zeros((len(x), len(forest.directions)), np.int64)
    for tree, (lines, marks) in enumerate(zip(forest.directions, forest.thresholds, strict=True)):
        node = np.zeros(len(x), np.int64)
        for _ in range(forest.levels):
            right = (points * lines[node]).sum(axis=1) >= marks[node]
            node = 2 * node + 1 + right
        out[:, tree] = node - len(marks)
    return out


def visits(query: np.ndarray, forest: Forest, counts: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """(tree, leaf) pairs, best first, until the leaves have `rows` ids by `counts`. One queue holds the open branches of all trees;
    a branch is as far as the farthest threshold that it lies beyond."""
    point = np.append(query, 0.0)
    margins = forest.directions @ point - forest.thresholds
    queue = [(0.0, tree, 0) for tree in range(len(margins))]
    inner, seen = margins.shape[1], 0
    while queue and seen < rows:
        far, tree, node = heapq.heappop(queue)
        while node < inner:
            margin = float(margins[tree, node])
            near = 2 * node + 1 + (margin >= 0)
            heapq.heappush(queue, (max(far, abs(margin)), tree, 4 * node + 3 - near))
            node = near
        if counts[tree, node - inner]:
            seen += int(counts[tree, node - inner])
            yield tree, node - inner


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
         floors: np.ndarray | None = None) -> list[tuple]:
    """(query_id, vec_id, score) arrays of the k other ids of the largest inner products with each query, ties to the smaller
    id; an id of several rows counts once, with its best. Scores below a query's floor are left out. A matrix product finds
    who may be among them; their scores are then computed row by row, in the same order of additions wherever they stand."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    repeated = len(starts) < len(ids)
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    longest = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))
    rounding = 8 * (x.shape[1] + 1) * np.finfo(np.float64).eps * longest  # of a product, for a query of length 1
    for i in range(0, len(queries), 256):
        part = slice(i, i + 256)
        for query_id, query, floor, near in zip(query_ids[part], queries[part], floors[part], queries[part] @ x.T, strict=True):
            near[ids == query_id] = -np.inf
            of_ids = np.maximum.reduceat(near, starts) if repeated else near
            take = min(k, len(of_ids))
            least = np.partition(of_ids, len(of_ids) - take)[len(of_ids) - take]
            least = max(least, floor)
            slack = rounding * np.sqrt(query @ query)
            own = np.flatnonzero((near >= least - slack) & (near > -np.inf))
            score = (x[own] * query).sum(axis=1)
            own, score = own[score >= floor], score[score >= floor]
            order = np.lexsort((ids[own], -score))
            if repeated:
                order = order[np.sort(np.unique(ids[own][order], return_index=True)[1])]
            order = order[:k]
            out.append((np.full(len(order), query_id), ids[own][order], score[order]))
    return out


def _result(found: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of vectors that take part: not null or zero, without null or non-finite
    components, with an id, and of the most frequent dimension."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select("vec_id", x.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite)
    rows = rows.where(F.exists("embedding", lambda v: v != 0))
    dimension = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (dimension["d"] if dimension else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest ids found for each query among all rows but its own id's.

    vectors: vec_id and embedding; rows that `valid` leaves out take no part, other columns are ignored. Repeated rows count
    once. An id of several vectors is listed once, with its best, and asked once, with its greatest vector. Trees are fitted
    on at most SAMPLE rows. How many ids the queue visits is measured: PROBES queries are compared with all rows, and the
    visits are as long as it takes to find `recall` of their neighbours, at least 64 * k ids. Leaves are cut to blocks of
    about BLOCK_ROWS rows and their queries to blocks of BLOCK_QUERIES, so a vector that a third of all rows have is many
    groups. Each group sends the best k ids of a query only, and none below the k-th best of the leaves visited first.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    each = rows.groupBy("vec_id", F.xxhash64("embedding").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("vec_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("x"))
    repeats = each.agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("ids")).first()
    if repeats["n"] != repeats["x"]:
        rows = shared.stored(rows.dropDuplicates(["vec_id", "embedding"]), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.sum(is_query.cast("long")).alias("queries")).first()
    schema = "query_id long, vec_id long, score double"
    if not facts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks())
    levels = int(np.clip(np.ceil(np.log2(max(facts["n"] / LEAF_ROWS, 1))), 1, LEVELS))
    forest = grow(sample, facts["longest"], trees, levels)
    known = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = leaves(_matrix(batch.column(1)), known.value) if batch.num_rows else np.zeros((0, trees), np.int64)
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(at), tree)), pa.array(at[:, tree])],
                    ["vec_id", "embedding", "tree", "leaf"])

    placed = rows.mapInArrow(place, "vec_id long, embedding array<double>, tree long, leaf long")
    counts, sizes = np.zeros((2, trees, 1 << levels), np.int64)  # ids and rows of each leaf
    several = repeats["x"] != repeats["ids"]
    n_ids = F.count_distinct("vec_id") if several else F.count(F.lit(1))
    for row in placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), n_ids.alias("ids")).collect():
        sizes[row["tree"], row["leaf"]], counts[row["tree"], row["leaf"]] = row["n"], row["ids"]
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("embedding").alias("query"))
    visited = max(_measured(rows, asked, forest, counts, k, recall), 64 * k)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [(j, tree, leaf, visit) for j, query in enumerate(_matrix(part.column(1)))
                         for visit, (tree, leaf) in enumerate(visits(query, known.value, counts, visited))]
                index, *columns = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), *map(pa.array, columns)],
                                                 ["query_id", "tree", "leaf", "visit"])

    probes = shared.stored(asked.mapInArrow(follow, "query_id long, tree long, leaf long, visit long"), "probes")
    asking = max(1, -(-facts["queries"] // BLOCK_QUERIES))
    blocks = spark.createDataFrame(
        [(t, f, max(1, -(-int(sizes[t, f]) // BLOCK_ROWS))) for t in range(trees) for f in range(1 << levels)], "tree long, leaf long, blocks int")
    blocks = F.broadcast(blocks)  # a row for each leaf, at most trees * 2 ** LEVELS
    placed = placed.join(blocks, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding") if several else F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(asking - 1))))
    group = ["tree", "leaf", "block", "asking"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _result([])
        x, queries = (_matrix(table[name].combine_chunks()) for table, name in ((left, "embedding"), (right, "query")))
        return _result(best(left["vec_id"].to_numpy(), x, right["query_id"].to_numpy(), queries, k, right["floor"].to_numpy()))

    def searched(part: DataFrame) -> DataFrame:
        part = part.join(blocks, ["tree", "leaf"]).withColumn("asking", F.pmod(F.xxhash64("query_id"), F.lit(asking)).cast("int"))
        part = part.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*group, "query_id", "query", "floor")
        return placed.select(*group, "vec_id", "embedding").groupBy(group).cogroup(part.groupBy(group)).applyInArrow(meet, schema)

    first = probes.where(F.col("visit") < FIRST_VISITS).join(asked, "query_id").withColumn("floor", F.lit(float("-inf")))
    first = shared.stored(_ranked(searched(first), k), "first")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    floors = floors.select("query_id", F.when(F.col("n") == k, F.col("low")).otherwise(float("-inf")).alias("floor"))
    rest = probes.where(F.col("visit") >= FIRST_VISITS).join(asked, "query_id").join(floors, "query_id", "left")
    rest = searched(rest.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    return _ranked(first.select("query_id", "vec_id", "score").unionAll(rest), k)


def _measured(rows: DataFrame, asked: DataFrame, forest: Forest, counts: np.ndarray, k: int, recall: float) -> int:
    """Ids to visit, so that `recall` of the exact neighbours of PROBES queries are found."""
    probes = asked.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(PROBES).toArrow()
    query_ids, queries = probes["query_id"].to_numpy(), _matrix(probes["query"].combine_chunks())
    known = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = _result(best(batch.column(0).to_numpy(), _matrix(batch.column(1)), *known.value, k))
                yield from table.to_batches()

    exact = _ranked(rows.mapInArrow(scan, "query_id long, vec_id long, score double"), k)
    product = F.aggregate(F.zip_with("embedding", "query", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    near = exact.join(rows.select("vec_id", "embedding"), "vec_id").join(asked, "query_id")
    near = near.groupBy("query_id", "vec_id").agg(F.max_by("embedding", product).alias("embedding")).toArrow()
    if not near.num_rows:
        return 0
    at = leaves(_matrix(near["embedding"].combine_chunks()), forest)
    of = near["query_id"].to_numpy()
    needed = []
    for query_id, query in zip(query_ids, queries, strict=True):
        seen, when = 0, {}
        for tree, leaf in visits(query, forest, counts, int(counts.sum())):
            seen += int(counts[tree, leaf])
            when[tree, leaf] = seen
        needed += [min(when[tree, leaf] for tree, leaf in enumerate(own)) for own in at[of == query_id].tolist()]
    return int(np.quantile(needed, recall, method="higher"))
