"""Hard negatives for anchors: candidates of a block are sorted once for each cluster of anchors by an angular upper bound
of their scores, and every member of the cluster walks that list until no candidate further down can count."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundweave.llm import shared

#: Anchors that the centroids of the clusters are fitted on, and the most clusters.
SAMPLE, CLUSTERS = 4096, 256
#: Rows of a block, and members of a cluster that are dealt to one salt when they look for blocks.
BLOCK_ROWS, MEMBERS = 4096, 1024
_CHUNK, _TURN = 256, 512
#: Share of |anchor| |candidate| that is added to bounds, for rounding of angles.
_SLACK = 1e-6
_LEAST = -(1 << 62)


def _numbers(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), len(values) // max(len(column), 1))


def _whole(column: pa.Array, scale: int) -> np.ndarray:
    return np.floor(scale * _numbers(column))


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norm > 0, norm, 1)[:, None], norm


def _centroids(sample: np.ndarray, clusters: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means; a cluster that loses all members keeps its centroid."""
    unit, norm = _unit(sample)
    unit = unit[norm > 0]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    centre = unit[np.random.default_rng(seed).permutation(len(unit))[:clusters]]
    for _ in range(rounds):
        own = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        fresh, size = _unit(total)
        centre = np.where((size > 0)[:, None], fresh, centre)
    return centre


def _angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre.T, -1, 1))


def _bounds(matrix: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each row and cluster, the most that the row's inner product with a unit vector of the cluster can be."""
    unit, norm = _unit(matrix)
    return norm[:, None] * np.cos(np.maximum(_angles(unit, centre) - radius, 0))


class _List:
    """The candidates of a block in the order of their bounds for one cluster."""

    def __init__(self, block: _Block, centre: np.ndarray, radius: float) -> None:
        bound = _bounds(block.matrix, centre[None], np.array([radius]))[:, 0]
        order = np.argsort(-bound, kind="stable")
        self.bound, self.ids, self.group = bound[order], block.ids[order], block.group[order]
        self.rows, self.longest = block.rows[order], block.longest


class _Block:
    def __init__(self, parts: list[pa.RecordBatch], scale: int, kind: type) -> None:
        table = pa.Table.from_batches(parts)
        matrix = _whole(table["vector"], scale)
        self.ids, self.group = table["id"].to_numpy(), table["group"].to_numpy()
        once = np.unique(np.column_stack([self.ids, self.group, matrix.view(np.int64)]), axis=0, return_index=True)[1]
        self.ids, self.group, self.matrix = self.ids[once], self.group[once], matrix[once]
        self.rows = self.matrix.astype(kind)
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix)).max())


def _first(request: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each request: largest score, then smallest id."""
    order = np.lexsort((ids, -score, request))
    own = request[order]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < k]


def _walk(listed: _List, rows: np.ndarray, norm: np.ndarray, ids: np.ndarray, group: np.ndarray, member: np.ndarray,
          low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, score, id) of the k best candidates of each request with low <= score <= high. A request leaves when its
    anchor's length times the bound at the place of the list is under its k-th score."""
    low = low.copy()
    found = np.zeros(0, np.int64), np.zeros(0, rows.dtype), np.zeros(0, np.int64)
    for start in range(0, len(listed.ids), _CHUNK):
        reach = norm * (listed.bound[start] + _SLACK * listed.longest)
        live = np.flatnonzero(reach[member] >= low)
        if not len(live):
            break
        part = slice(start, start + _CHUNK)
        asked, at = np.unique(member[live], return_inverse=True)
        fits = ((group[asked][:, None] == listed.group[part]) == same) & (ids[asked][:, None] != listed.ids[part])
        scores = (rows[asked] @ listed.rows[part].T)[at]
        r, c = np.nonzero(fits[at] & (scores >= low[live][:, None]) & (scores <= high[live][:, None]))
        if not len(r):
            continue
        request, score, ident = (np.concatenate(x) for x in zip(found, (live[r], scores[r, c], listed.ids[part][c]), strict=True))
        kept = _first(request, score, ident, k)
        found = request[kept], score[kept], ident[kept]
        full = np.flatnonzero(np.bincount(found[0], minlength=len(low)) >= k)
        low[full] = found[1][np.searchsorted(found[0], full) + k - 1]
    return found


def _visits(centre: np.ndarray, radius: np.ndarray, scale: int, kind: type, k: int, same: bool):
    """Reads rows sorted by block, candidates first, then anchors by cluster; gives each anchor's best of the block."""
    fields = ["a", "request", "id", "score"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block, own, listed = None, [], None, None, None
        for batch in batches:
            places = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
                      for n in ("block", "is_anchor", "cluster")]
            change = np.any([p[1:] != p[:-1] for p in places], axis=0) if batch.num_rows > 1 else np.zeros(0, bool)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                name, asks, cluster = (p[start] for p in places)
                if name != now:
                    now, parts, block, own = name, [], None, None
                if not asks:
                    parts.append(batch.slice(start, stop - start))
                    continue
                if not parts:
                    continue
                if block is None:
                    block = _Block(parts, scale, kind)
                if own != cluster:
                    own, listed = cluster, _List(block, centre[cluster], radius[cluster])
                for i in range(start, stop, _TURN):
                    turn = batch.slice(i, min(_TURN, stop - i))
                    matrix = _whole(turn.column(turn.schema.get_field_index("vector")), scale)
                    of = {n: turn.column(turn.schema.get_field_index(n)) for n in ("a", "id", "group", "request", "low", "high")}
                    member = np.repeat(np.arange(len(matrix)), of["low"].value_lengths().to_numpy())
                    request, score, ident = _walk(
                        listed, matrix.astype(kind), _unit(matrix)[1], of["id"].to_numpy(), of["group"].to_numpy(), member,
                        *(of[n].flatten().to_numpy().astype(kind) for n in ("low", "high")), k, same)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of["a"].to_numpy()[member[request]]), pa.array(of["request"].flatten().to_numpy()[request]),
                         pa.array(ident), pa.array(score.astype(np.int64))], fields)

    return read


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "request").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Search:
    """Candidates in blocks of near rows, anchors in clusters, and what each block can reach at most for each cluster."""

    def __init__(self, rows: DataFrame, is_anchor: Column, scale: int, block_rows: int, clusters: int, sample: int) -> None:
        self.spark, self.scale = rows.sparkSession, scale
        asked = rows.where(is_anchor)
        n = rows.count()
        picked = asked.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"]
        self.empty = not n or not len(picked)
        if self.empty:
            return
        known = _whole(picked, scale)
        clusters = min(clusters, max(1, round(math.sqrt(len(known)))))
        self.centre = _centroids(known, clusters)
        placed = shared.stored(self._placed(rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))), "placed")
        totals = placed.groupBy("cluster").agg(  # a row for each cluster
            F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("members"), F.max("squared").alias("squared"),
            F.max(F.when(F.col("is_anchor"), F.col("angle"))).alias("radius")).collect()
        most = max(r["squared"] for r in totals)
        if not most < 2**63:
            raise ValueError("scores of these vectors don't fit a long")
        self.kind = np.float64 if most < 2**53 else np.int64  # products and their sums are exact in either
        self.radius = np.zeros(len(self.centre))
        size = max(256, min(block_rows, -(-n // 64)))  # blocks for at least 64 tasks, unless they would be tiny
        dealt, first = [], 0
        for r in sorted(totals, key=lambda r: r["cluster"]):
            self.radius[r["cluster"]] = r["radius"] or 0.0
            shards = -(-r["n"] // size)
            dealt.append((r["cluster"], first, shards, max(1, -(-r["members"] // MEMBERS))))
            first += shards
        # A row for each cluster, so at most CLUSTERS.
        self.dealt = F.broadcast(self.spark.createDataFrame(dealt, "cluster int, first int, shards int, salts int"))
        near = F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
        self.rows = shared.stored(placed.join(self.dealt, "cluster").withColumn("block", near).drop("first", "shards"), "blocks")
        shared.dropped(placed)
        once = self.rows.where("is_anchor").dropDuplicates(["id", "group", "vector"])
        self.anchors = shared.stored(once.select(
            F.monotonically_increasing_id().alias("a"), "id", "group", "vector", "cluster", "block",
            F.sqrt("squared").alias("norm"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")), "anchors")
        self.bounds = shared.stored(self._block_bounds(), "bounds")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Adds the nearest centroid, the angle to it and the squared length."""
        known, scale = self.spark.sparkContext.broadcast(self.centre), self.scale
        schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()),
                               T.StructField("angle", T.DoubleType()), T.StructField("squared", T.DoubleType())])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                matrix = _whole(batch.column(batch.schema.get_field_index("vector")), scale)
                if matrix.shape[1] != known.value.shape[1]:
                    raise ValueError("vectors of several lengths have no inner product")
                angle = _angles(_unit(matrix)[0], known.value)
                own = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle[np.arange(len(own)), own]),
                     pa.array(np.einsum("ij,ij->i", matrix, matrix))], [*batch.schema.names, "cluster", "angle", "squared"])

        return rows.mapInArrow(place, schema)

    def _block_bounds(self) -> DataFrame:
        """block, cluster, salt, reach: the largest bound of the block's rows for the cluster."""
        centre, radius, scale = self.centre, self.radius, self.scale

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bound = _bounds(_whole(batch.column(1), scale), centre, radius)
                block = batch.column(0).to_numpy()
                order = np.argsort(block, kind="stable")
                names, starts = np.unique(block[order], return_index=True)
                most = np.maximum.reduceat(bound[order], starts, axis=0) + _SLACK * np.abs(bound).max()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.FixedSizeListArray.from_arrays(pa.array(most.ravel()), most.shape[1]).cast(pa.list_(pa.float64()))],
                    ["block", "most"])

        per_batch = self.rows.select("block", "vector").mapInArrow(reach, "block int, most array<double>")
        per_block = per_batch.select("block", F.posexplode("most").alias("cluster", "reach")).groupBy("block", "cluster").agg(
            F.max("reach").alias("reach"))
        salts = per_block.join(self.dealt.select("cluster", "salts"), "cluster")
        return salts.select("block", "cluster", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "reach")

    def _visit(self, asking: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best of each request among the blocks that the anchors in `asking` (with column block) are sent to."""
        columns = ["block", "is_anchor", "cluster", "a", "id", "group", "vector", "request", "low", "high"]
        none = {"a": F.lit(0).cast("long"), **{n: F.array().cast("array<long>") for n in ("request", "low", "high")}}
        candidates = self.rows.withColumns({**none, "is_anchor": F.lit(False), "cluster": F.lit(-1)}).select(*columns)
        both = candidates.unionAll(asking.withColumn("is_anchor", F.lit(True)).select(*columns))
        sorted_rows = both.repartition("block").sortWithinPartitions("block", "is_anchor", "cluster")
        found = sorted_rows.mapInArrow(_visits(self.centre, self.radius, self.scale, self.kind, k, same),
                                       "a long, request long, id long, score long")
        return _best(found, k)

    def best(self, asking: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """a, request, id, score, rank: the k best of each request. First each anchor looks into its own block; then into
        every block whose reach isn't under the k-th score of all its requests."""
        asking = shared.stored(asking, f"{name}-asked")
        seen = self._visit(asking, k, same).groupBy("a", "request").agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        seen = seen.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("request", "least"))).alias("seen"))
        higher = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("seen", F.get("request", i)), x)))
        raised = asking.join(seen, "a", "left").withColumn("low", higher).drop("seen")
        raised = raised.drop("block").join(self.bounds, ["cluster", "salt"]).where(
            F.col("norm") * F.col("reach") >= F.array_min("low"))
        found = shared.stored(self._visit(raised, k, same), name)
        shared.dropped(asking)
        return found


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, block_rows: int = BLOCK_ROWS, clusters: int = CLUSTERS, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of `rows` (vec_id, a whole
    number; label; embedding) with is_anchor, and each of its `positives` best other rows of the same label, the `negatives`
    best rows of other labels with low % <= negative score / positive score <= high %. A score is the inner product of
    floor(scale * x) of all components; equal scores go by smaller vec_id.

    The result is exact. Clusters are fitted on at most `sample` anchors; all anchors join one, all rows lie in blocks of at
    most about `block_rows` rows. No candidate is copied: anchors are sent to blocks. A block's task sorts its candidates
    once for each cluster, by |candidate| cos(max(0, angle to the centroid - radius of the cluster)); an anchor walks down
    until its length times that bound is under its k-th score. Each anchor walks its own block first, and then only visits
    blocks that can hold something better.

    Rows with a null vec_id, label or vector, without components or with a null or non-finite one take no part; is_anchor
    null counts as false. Rows equal in vec_id, label and vector count once, and no row is a partner of an anchor with its
    vec_id. Labels equal as text are the same. Fewer rows than asked are all returned; a negative positive score has no
    negatives. Other columns are ignored, an empty table gives no row. Vectors of different lengths, or lengths whose
    square is 2^63 or more, raise an error.
    """
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label")
    whole = isinstance(rows.schema["label"].dataType, T.IntegralType)
    known = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & (F.size("embedding") > 0) & usable).select(
        F.col("vec_id").cast("long").alias("id"), (label.cast("long") if whole else F.xxhash64(label.cast("string"))).alias("group"),
        F.col("embedding").alias("vector"), is_anchor.alias("asks"))
    search = _Search(known.select("id", "group", "vector", "asks"), F.col("asks"), scale, block_rows, clusters, sample)
    fields = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if search.empty:
        return rows.sparkSession.createDataFrame([], fields)
    one = {"request": F.array(F.lit(0).cast("long")), "low": F.array(F.lit(_LEAST).cast("long")), "high": F.array(F.lit(-_LEAST).cast("long"))}
    near = search.best(search.anchors.withColumns(one), positives, True, "positives").select("a", F.col("id").alias("p"), F.col("score").alias("s"))
    wide = F.col("s").cast("decimal(20,0)")
    window = near.select("a", F.struct(
        F.col("p").alias("request"), F.ceil(wide * low / 100).cast("long").alias("low"),
        F.floor(wide * high / 100).cast("long").alias("high")).alias("w")).where("w.low <= w.high")
    windows = window.groupBy("a").agg(F.array_sort(F.collect_list("w")).alias("w"))  # as many as positives
    asking = search.anchors.join(windows, "a").select(
        *search.anchors.columns, *(F.col(f"w.{n}").alias(n) for n in ("request", "low", "high")))
    far = search.best(asking, negatives, False, "negatives").withColumnsRenamed({"request": "p", "id": "negative_id", "score": "negative_score"})
    return far.join(near, ["a", "p"]).join(search.anchors.select("a", F.col("id").alias("anchor_id")), "a").select(
        "anchor_id", F.col("p").alias("positive_id"), "rank", "negative_id", F.col("s").alias("positive_score"), "negative_score")
