"""Greedy packing of ordered rows into token-bounded chunks, as a parallel scan.

A row opens a new chunk when the open chunk already has rows and would exceed
the limit. That looks sequential, yet a run of rows acts on the packing only
through one number: the tokens held by the open chunk. So

1. rows are sorted over range partitions by fund and order, and cut into blocks
   of consecutive rows of one fund, bounded in rows and bytes and stored,
2. a run of rows is summarised as "tokens held before -> tokens held after and
   chunks opened", at most one entry for each possible first break; two such
   summaries compose to one of the same size, in any grouping,
3. only the first fund of a partition can have begun before it. What enters
   each partition comes from a tree over the partitions' summaries, composed
   upwards and handed down, a few partitions to a task,
4. every block is cut on its own, knowing what enters it.

A fund holding a third of all rows lies in a third of the partitions; many small
funds share one. Rows are shuffled once; only chunks across a block's edge are
grouped afterwards, from the rows that can belong to them, which a block also
holds apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fundweave import fixed_values as fv
from fundweave.session import scratch_path, settings

#: Rows and bytes of a block, and of the row groups that blocks are stored in: a reader decodes a whole group at once.
BLOCK_ROWS = 512
BLOCK_BYTES = 1024 * 1024
_GROUP_BYTES, _GROUP_CHECK = 8 * 1024 * 1024, 8
#: Shuffled bytes that a task sorts and cuts: many more as texts, so tasks of Spark's usual 64 MB take long, and are few.
_SORTED_BYTES = 16 * 1024 * 1024
#: Neighbours in the tree that one task composes.
FAN = 32


class Summary(NamedTuple):
    """What a run of rows does to the open chunk. If it holds ``held`` tokens, the first break is where a running total
    of ``reach`` first exceeds ``limit - held``; ``carry`` and ``opened`` tell what follows from there. Without a break,
    ``total`` is added."""

    reach: np.ndarray
    carry: np.ndarray
    opened: np.ndarray
    total: int


_NONE = np.zeros(0, np.int64)
NOTHING = Summary(_NONE, _NONE, _NONE, 0)


def fresh(limit: int) -> int:
    """The held tokens that stand for no open chunk: the next row opens one whatever its size."""
    return limit + 1


def _breaks(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Running token totals, and for each row where the chunk opened there would end; the end leads to itself."""
    totals = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    rows = np.arange(len(tokens))
    ends = np.searchsorted(totals, totals[:-1] + limit, side="right") - 1
    return totals, np.append(np.maximum(ends, rows + 1), len(tokens))


def summarise(tokens: np.ndarray, limit: int) -> Summary:
    """The summary of a block, by doubling the number of chunks that are jumped over."""
    totals, jump = _breaks(tokens, limit)
    n = len(tokens)
    opened = np.append(np.ones(n, np.int64), 0)
    last = np.arange(n + 1)
    while (jump < n).any():
        opened = opened + opened[jump]
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    beyond = int(np.searchsorted(totals[1:], limit, side="right")) + 1
    reach, first = np.unique(totals[1:beyond + 1], return_index=True)
    return Summary(reach, totals[n] - totals[last[first]], opened[first], int(totals[n]))


def after(summary: Summary, held: np.ndarray | int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens held after the run, and chunks opened in it."""
    held = np.asarray(held, np.int64)
    at = np.searchsorted(summary.reach, limit - held, side="right")
    hit = at < len(summary.reach)
    if not len(summary.reach):
        return held + summary.total, np.zeros_like(held)
    at = np.minimum(at, len(summary.reach) - 1)
    return np.where(hit, summary.carry[at], held + summary.total), np.where(hit, summary.opened[at], 0)


def compose(first: Summary, second: Summary, limit: int) -> Summary:
    """The summary of two runs, one after the other. Associative, and bounded by the limit."""
    carry, opened = after(second, first.carry, limit)
    parts = first.reach, carry, first.opened + opened
    if first.total <= limit:  # an open chunk can pass the whole first run
        reach = first.total + second.reach
        end = int(np.searchsorted(reach, limit, side="right")) + 1
        new = slice(int(np.searchsorted(reach, first.reach[-1], side="right")) if len(first.reach) else 0, end)
        parts = tuple(np.concatenate(p) for p in zip(parts, (reach[new], second.carry[new], second.opened[new])))
    return Summary(*parts, first.total + second.total)


def chunk_starts(tokens: np.ndarray, limit: int, held: int) -> np.ndarray:
    """Row positions inside a block at which a chunk opens."""
    totals, jump = _breaks(tokens, limit)
    reached = np.zeros(len(tokens) + 1, bool)
    reached[int(np.searchsorted(totals[1:], limit - held, side="right"))] = True
    while True:
        places = np.flatnonzero(reached)
        ahead = jump[places]
        if reached[ahead].all():
            return places[places < len(tokens)]
        reached[ahead] = True
        jump = jump[jump]


# --- blocks -------------------------------------------------------------------

_SUMMARY = "struct<reach: array<bigint>, carry: array<bigint>, opened: array<bigint>, total: bigint>"
_ARROW_SUMMARY = pa.struct([*((n, pa.list_(pa.int64())) for n in ("reach", "carry", "opened")), ("total", pa.int64())])


def _plain(summary: Summary) -> dict:
    return {"reach": summary.reach, "carry": summary.carry, "opened": summary.opened, "total": summary.total}


def _read(value: dict) -> Summary:
    return Summary(*(np.asarray(value[n], np.int64) for n in ("reach", "carry", "opened")), int(value["total"]))


class _Cutter:
    """Cuts the sorted rows of one partition into blocks, and follows the packing as far as it is known."""

    def __init__(self, schema: pa.Schema, n_keys: int, limit: int, block_rows: int, block_bytes: int):
        self.schema, self.n_keys, self.limit = schema, n_keys, limit
        self.block_rows, self.block_bytes = block_rows, block_bytes
        self.part = TaskContext.get().partitionId()
        self.parts: list[pa.RecordBatch] = []
        self.rows = self.bytes = self.seq = 0
        self.runs = 0
        self.begin()

    def begin(self) -> None:
        """A fund begins. What the first one of a partition has before is not known here."""
        self.runs += 1
        self.prefix = NOTHING if self.runs == 1 else None
        self.held, self.base = fresh(self.limit), 0

    def add(self, batch: pa.RecordBatch) -> Iterator[dict]:
        """Rows of the fund; gives the blocks that are full."""
        each = max(1, batch.nbytes // batch.num_rows)
        while batch.num_rows:
            room = min(self.block_rows - self.rows, (self.block_bytes - self.bytes) // each)
            taken = batch.slice(0, max(room, 0 if self.rows else 1))
            if taken.num_rows:
                self.parts.append(taken)
                self.rows, self.bytes = self.rows + taken.num_rows, self.bytes + each * taken.num_rows
                batch = batch.slice(taken.num_rows)
            if batch.num_rows:
                yield self.close(False)

    def close(self, ends: bool) -> dict:
        """The open block; ``ends`` tells that no row of its fund follows."""
        table = pa.Table.from_batches(self.parts)
        keys = {name: table[name][0] for name in self.schema.names[:self.n_keys]}
        summary = summarise(table["_tokens"].to_numpy().astype(np.int64), self.limit)
        rows, tokens = table["_row"].combine_chunks(), table["_tokens"].combine_chunks()
        head, tail = self.margins(tokens.to_numpy().astype(np.int64), ends)
        block = {**keys, "part": self.part, "seq": self.seq, "ends": ends, "prefix": self.prefix, "held": self.held, "base": self.base,
                 "head": None if head is None else rows.slice(0, head), "tail": None if tail is None else rows.slice(tail),
                 "rows": rows, "tokens": tokens, "edge": None, "fixed": None}
        if self.prefix is not None:
            self.prefix = compose(self.prefix, summary, self.limit)
        held, opened = after(summary, self.held, self.limit)
        self.held, self.base = int(held), self.base + int(opened)
        self.parts, self.rows, self.bytes, self.seq = [], 0, 0, self.seq + 1
        return block

    def margins(self, tokens: np.ndarray, ends: bool) -> tuple[int | None, int | None]:
        """How many of the first rows, and from which on the last rows can belong to a chunk across the block's edge: those
        that fit a chunk together, one at least. None where there is no such chunk, or where the first rows are all."""
        if ends and self.prefix is None and not self.base:  # the whole fund
            return None, None
        totals = np.cumsum(tokens)
        head = max(1, int(np.searchsorted(totals, self.limit, side="right")))
        if ends or head == len(tokens):
            return head, None
        before = totals - tokens
        return head, min(len(tokens) - 1, int(np.searchsorted(before, totals[-1] - self.limit, side="left")))

    def edge(self, keys: dict) -> dict:
        """What the partition hands on: the state of its last fund, or, if that is its only one, its summary."""
        known = Summary(_NONE, np.array([self.held]), np.array([self.base]), 0)
        return {**keys, "part": self.part, "seq": -1, "ends": None, "prefix": None, "held": None, "base": None, "rows": None, "tokens": None,
                "head": None, "tail": None, "edge": known if self.prefix is None else self.prefix, "fixed": self.prefix is None}


def _as_batch(blocks: list[dict], fields: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field in fields:
        values = [b[field.name] for b in blocks]
        if field.name in ("rows", "tokens", "head", "tail"):
            at = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
            missing = pa.array([v is None for v in values])
            flat = [v for v in values if v is not None]
            whole = pa.concat_arrays([v.cast(field.type.value_type) for v in flat]) if flat else pa.array([], field.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array(at), whole, mask=missing))
        elif field.name in ("prefix", "edge"):
            columns.append(pa.array([None if v is None else _plain(v) for v in values], _ARROW_SUMMARY))
        else:
            columns.append(pa.array([v.as_py() if isinstance(v, pa.Scalar) else v for v in values], field.type))
    return pa.RecordBatch.from_arrays(columns, schema=fields)


def _cut_blocks(n_keys: int, limit: int, block_rows: int, block_bytes: int, fields: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, done, before = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in range(n_keys)]
            if cutter is None:
                cutter = _Cutter(batch.schema, n_keys, limit, block_rows, block_bytes)
            elif [k[0] for k in keys] != before:
                done.append(cutter.close(True))
                cutter.begin()
            differs = reduce(pc.or_, (pc.not_equal(k[1:], k[:-1]) for k in keys))
            edges = [0, *(np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if start:
                    done.append(cutter.close(True))
                    cutter.begin()
                done += cutter.add(batch.slice(start, stop - start))
                if sum(len(b["tokens"]) for b in done) >= block_rows:
                    yield _as_batch(done, fields)
                    done = []
            before = [k[-1] for k in keys]
        if cutter is not None:
            done.append(cutter.close(False))
            names = fields.names[:n_keys]
            yield _as_batch([*done, cutter.edge(dict(zip(names, before)))], fields)

    return cut


def stored_blocks(rows: DataFrame, keys: list[str], order: str = "row_ord", tokens: str = "n_tokens",
                  max_tokens: int = fv.CHUNK_TOKENS, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES,
                  late: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Blocks of consecutive rows of one fund, and a row of what each partition hands on (``rows`` null), stored.

    ``late`` adds columns row by row, ``tokens`` among them, once the rows are sorted: what makes them before is run twice,
    in as few tasks as the files give. So are joins before it; one whose shuffled smaller side turns out to fit is not made by
    sorting all rows, twice. There are at most ``rows / block_rows`` blocks more than funds and partitions together, besides those that are
    full in bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    placed = rows.filter(reduce(and_, (F.col(k).isNotNull() for k in (*keys, order))))
    ordered = placed.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    ordered = late(ordered) if late else ordered
    payload = [c for c in ordered.columns if c not in (*keys, order)]
    ordered = ordered.select(
        *keys, F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("_tokens"), F.struct(order, *payload).alias("_row"))
    row = ordered.schema["_row"].dataType
    fields = T.StructType([
        *(ordered.schema[k] for k in keys), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
        T.StructField("ends", T.BooleanType()), T.StructField("held", T.LongType()), T.StructField("base", T.LongType()),
        T.StructField("prefix", T._parse_datatype_string(_SUMMARY)), T.StructField("fixed", T.BooleanType()),
        T.StructField("edge", T._parse_datatype_string(_SUMMARY)),
        T.StructField("tokens", T.ArrayType(T.LongType())), *(T.StructField(name, T.ArrayType(row)) for name in ("head", "tail", "rows"))])
    path = scratch_path(spark, "blocks")
    blocks = ordered.mapInArrow(_cut_blocks(len(keys), max_tokens, block_rows, block_bytes, to_arrow_schema(fields)), fields)
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes=_SORTED_BYTES,
                  spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=_SORTED_BYTES):
        blocks.write.option("parquet.block.size", _GROUP_BYTES).option("parquet.page.size.row.check.min", _GROUP_CHECK).parquet(path)
    return spark.read.schema(fields).parquet(path)


# --- the tree -----------------------------------------------------------------

class _State(NamedTuple):
    """The last fund up to some place, and a known state of it or how it depends on what was before."""

    key: dict
    fixed: bool
    summary: Summary

    def then(self, other: _State, limit: int) -> _State:
        if other.fixed or (self.key == other.key and not self.fixed):
            return other if other.fixed else _State(other.key, False, compose(self.summary, other.summary, limit))
        held, base = (self.summary.carry[0], self.summary.opened[0]) if self.key == other.key else (fresh(limit), 0)
        held, opened = after(other.summary, held, limit)
        return _State(other.key, True, Summary(_NONE, np.array([held]), np.array([base + opened]), 0))


def _states(table: pa.Table) -> list[tuple[int, _State]]:
    found = ((r["pos"], _State(r["key"], r["fixed"], _read(r["edge"]))) for r in table.to_pylist())
    return sorted(found, key=lambda x: x[0])


def _fold(limit: int, fields: pa.Schema):
    """One state for a group of neighbours."""

    def fold(table: pa.Table) -> pa.Table:
        places = _states(table)
        state = reduce(lambda a, b: a.then(b, limit), (s for _, s in places))
        row = {"pos": places[0][0] // FAN, "key": state.key, "fixed": state.fixed, "edge": _plain(state.summary)}
        return pa.Table.from_pylist([row], fields)

    return fold


def _hand_down(limit: int, fields: pa.Schema):
    """What enters each of a group of neighbours, from what enters the group (no row: nothing)."""

    def down(members: pa.Table, entering: pa.Table) -> pa.Table:
        state = None
        for row in entering.to_pylist():
            state = _State(row["key"], True, Summary(_NONE, np.array([row["held"]]), np.array([row["base"]]), 0))
        out = []
        for pos, own in _states(members):
            if state is not None:
                out.append({"pos": pos, "key": state.key, "held": int(state.summary.carry[0]), "base": int(state.summary.opened[0])})
                state = state.then(own, limit)
            else:  # the very first: its fund is fresh
                state = _State(own.key, True, Summary(_NONE, np.array([fresh(limit)]), np.array([0]), 0)).then(own, limit)
        return pa.Table.from_pylist(out, fields)

    return down


def _entering(items: DataFrame, places: int, limit: int, schema: T.StructType) -> DataFrame:
    """``pos, key, held, base``: the fund and state before each place, by a tree of groups of ``FAN`` places."""
    from pyspark.sql.pandas.types import to_arrow_schema

    grouped = items.withColumn("group", F.expr(f"pos div {FAN}").cast("int"))
    if places > FAN:
        upper = grouped.groupBy("group").applyInArrow(_fold(limit, to_arrow_schema(items.schema)), items.schema)
        outer = _entering(upper, -(-places // FAN), limit, schema)
    else:
        outer = items.filter(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    outer = outer.withColumnRenamed("pos", "group")
    return grouped.groupBy("group").cogroup(outer.groupBy("group")).applyInArrow(_hand_down(limit, to_arrow_schema(schema)), schema)


def _cuts_udf(limit: int):
    """Where a block is cut: the number of its first chunk, the first rows of all, and whether the first one begins here and
    the last one ends here."""

    @F.arrow_udf("struct<first:bigint,starts:array<int>,begins:boolean,ends:boolean>")
    def cut(blocks: pa.Array, held: pa.Array, base: pa.Array, prefix: pa.Array, ends: pa.Array) -> pa.Array:
        first, starts, begins, closed = [], [], [], []
        for k, own, number, before, last in zip(range(len(blocks)), held.to_pylist(), base.to_pylist(), prefix, ends.to_pylist()):
            if before.is_valid:  # what entered the partition passes the blocks before this one
                own, opened = after(_read(before.as_py()), own, limit)
                number += int(opened)
            at = chunk_starts(blocks[k].values.to_numpy().astype(np.int64), limit, int(own))
            begins.append(bool(len(at) and at[0] == 0))
            if not begins[-1]:
                at, number = np.append(0, at), number - 1
            first.append(number)
            starts.append(at)
            closed.append(last and (len(at) > 1 or begins[-1]))
        bounds = np.concatenate([[0], np.cumsum([len(at) for at in starts])])
        flat = np.concatenate([np.zeros(0, np.int32), *starts])
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
        names = ["first", "starts", "begins", "ends"]
        return pa.StructArray.from_arrays([pa.array(first, pa.int64()), listed, pa.array(begins, pa.bool_()), pa.array(closed, pa.bool_())], names)

    return cut


def pack_pieces(
    rows: DataFrame,
    keys: list[str],
    order: str = "row_ord",
    tokens: str = "n_tokens",
    max_tokens: int = fv.CHUNK_TOKENS,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
    late: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``keys, chunk_no, piece``: the rows of each chunk as an array in ``order``, one row per chunk.

    ``order`` must be unique within ``keys``; a row without a key or an order belongs to no chunk, and one without
    tokens counts none. The blocks are stored when this is called; cutting them is left to the caller's job. ``late`` as in
    stored_blocks.
    """
    blocks = stored_blocks(rows, keys, order, tokens, max_tokens, block_rows, block_bytes, late)
    edges = blocks.filter("edge IS NOT NULL").select(F.col("part").alias("pos"), F.struct(*keys).alias("key"), "fixed", "edge")
    entry = T.StructType([edges.schema["pos"], edges.schema["key"], T.StructField("held", T.LongType()), T.StructField("base", T.LongType())])
    places = (edges.agg(F.max("pos")).first()[0] or 0) + 1
    entering = _entering(edges, places, max_tokens, entry).select(
        F.col("pos").alias("part"), F.col("key").alias("_key"), F.col("held").alias("_held"), F.col("base").alias("_base"))

    known = blocks.filter("seq >= 0").join(F.broadcast(entering), "part", "left")  # a row per partition
    goes_on = F.col("prefix").isNotNull() & F.coalesce(reduce(and_, (F.col(f"_key.{k}") == F.col(k) for k in keys)), F.lit(False))
    unknown = F.col("prefix").isNotNull()
    held = F.when(goes_on, F.col("_held")).when(unknown, F.lit(fresh(max_tokens))).otherwise(F.col("held"))
    base = F.when(goes_on, F.col("_base")).when(unknown, F.lit(0)).otherwise(F.col("base"))
    cuts = _cuts_udf(max_tokens)(F.col("tokens"), held.cast("long"), base.cast("long"), F.col("prefix"), F.col("ends"))
    cut = known.select(*keys, "tokens", "head", "tail", "rows", cuts.alias("_cuts"))
    starts, count, size = F.col("_cuts.starts"), F.size("_cuts.starts"), F.size("tokens")

    def piece(number: Column, taken: Callable[[Column, Column], Column]) -> Column:
        start, stop = F.get(starts, number), F.coalesce(F.get(starts, number + 1), size)
        return F.struct((F.col("_cuts.first") + number).alias("chunk_no"), taken(start, stop - start).alias("piece"))

    def pieces(numbers: Column, taken: Callable[[Column, Column], Column]) -> DataFrame:
        return cut.select(*keys, F.inline(F.transform(numbers, lambda number: piece(number, taken))))

    def inside(start: Column, length: Column) -> Column:
        return F.slice("rows", start + 1, length)

    def margin(start: Column, length: Column) -> Column:
        """Of the first rows, or else the last ones; the block's own rows are not read for it."""
        return F.when((start == 0) | F.col("tail").isNull(), F.slice("head", start + 1, length)).otherwise(
            F.slice("tail", start - size + F.size("tail") + 1, length))

    def begins_and_ends(number: Column) -> Column:
        return (F.col("_cuts.begins") | (number > 0)) & (F.col("_cuts.ends") | (number < count - 1))

    edge = F.filter(F.array_distinct(F.array(F.lit(0), count - 1)), lambda n: ~begins_and_ends(n))
    parts = F.sort_array(F.collect_list(F.struct(F.get("piece", F.lit(0))[order].alias("at"), F.col("piece").alias("piece"))))
    joined = (
        pieces(edge, margin).groupBy(*keys, "chunk_no")
        .agg(F.flatten(F.transform(parts, lambda p: p["piece"])).alias("piece"))
    )
    return pieces(F.filter(F.sequence(F.lit(0), count - 1), begins_and_ends), inside).unionByName(joined)


def pack(rows: DataFrame, keys: list[str], **options) -> DataFrame:
    """The rows again, each with its ``chunk_no`` (from 0, per ``keys``)."""
    return pack_pieces(rows, keys, **options).select(*keys, "chunk_no", F.inline("piece"))


def add_overlap(
    packed: DataFrame,
    keys: list[str],
    overlap_tokens: int,
    order: str = "row_ord",
    tokens: str = "n_tokens",
) -> DataFrame:
    """Repeat the closing rows of a chunk, up to ``overlap_tokens``, at the head of the next one."""
    if overlap_tokens <= 0:
        return packed
    backwards = Window.partitionBy(*keys, "chunk_no").orderBy(F.col(order).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = packed.groupBy(*keys).agg(F.max("chunk_no").alias("_last"))
    repeated = (
        packed.withColumn("_tail", F.sum(tokens).over(backwards))
        .filter(F.col("_tail") <= overlap_tokens)
        .join(last, keys).filter(F.col("chunk_no") < F.col("_last"))
        .withColumn("chunk_no", F.col("chunk_no") + 1)
        .drop("_tail", "_last")
    )
    return packed.unionByName(repeated)
