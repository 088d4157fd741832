"""Ordered computations along a key that stay parallel when one key is hot.

A window over ``partitionBy(key)`` puts all rows of a key in one task. Here the
rows are range-partitioned on (key, order) first, so a hot key covers many
partitions ("blocks"). Each block is one pass in order, made before the blocks are
stored, and what the earlier blocks of the same key pass on is one value, as only
the first key of a block can have begun before it: it is added when they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfwise.session import cut_lineage

BLOCK = "_block"
RUN = "_run"


def _in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None) -> DataFrame:
    columns = [F.col(c).asc_nulls_last() for c in (*keys, *order)]
    spread = df.repartitionByRange(blocks, *columns) if blocks else df.repartitionByRange(*columns)
    return spread.sortWithinPartitions(*columns).withColumn(BLOCK, F.spark_partition_id())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row of compressed bytes."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            yield from pa.ipc.open_stream(packed.as_buffer())


def _store(rows: DataFrame, schema: T.StructType, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``work`` makes of each partition, ``schema``, stored column by column and compressed: a row has many columns that hardly change along a key."""
    return cut_lineage(rows.mapInArrow(lambda batches: _packed(work(batches)), "packed binary")).mapInArrow(_unpacked, schema)


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored, and the shuffles it needed gone: a placement samples its rows before it moves them."""
    return _store(df, df.schema, iter)


def range_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """Rows sorted by (keys, order) over the partitions, with the partition number.

    The checkpoint fixes which row lies in which block: range boundaries come
    from sampling and would differ if the shuffle ran again. Without ``blocks``
    AQE picks the partition count from the shuffled size.
    """
    return stored(_in_blocks(df, keys, order, blocks))


def _run_starts(keys: pa.Array) -> np.ndarray:
    """Where another key begins than the one before; NULLs are one key."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    one, two = keys[:-1], keys[1:]
    other = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
    other |= pc.is_null(one).to_numpy(zero_copy_only=False) != pc.is_null(two).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(other) + 1))


class _Sum:
    """Running sum of a whole number; NULL counts as 0."""

    def __init__(self):
        self.state = 0

    def over(self, values: pa.Array, starts: np.ndarray, goes_on: bool) -> pa.Array:
        v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.cumsum(v)
        before = np.where(starts > 0, sums[starts - 1], 0)
        if goes_on:
            before[0] -= self.state
        sums -= np.repeat(before, np.diff(starts, append=len(v)))
        self.state = int(sums[-1])
        return pa.array(sums)

    @staticmethod
    def joined(earlier, later):
        return later if earlier is None else earlier + later

    @staticmethod
    def entered(run: Column, carried: Column) -> Column:
        return run + carried


class _Last:
    """The latest value that is not NULL, of any type."""

    def __init__(self):
        self.state = None

    def over(self, values: pa.Array, starts: np.ndarray, goes_on: bool) -> pa.Array:
        n = len(values)
        known = np.where(pc.is_valid(values).to_numpy(zero_copy_only=False), np.arange(n), -1)
        known = np.maximum.accumulate(known)
        first = np.repeat(starts, np.diff(starts, append=n))
        carried = self.state if goes_on and self.state is not None else None
        at = np.where(known >= first, known + 1, 0)
        missing = (at == 0) & ((first > 0) | (carried is None))
        pool = pa.concat_arrays([pa.array([carried], values.type), values])
        out = pool.take(pa.array(at, mask=missing))
        self.state = out[-1].as_py()
        return out

    @staticmethod
    def joined(earlier, later):
        return earlier if later is None else later

    @staticmethod
    def entered(run: Column, carried: Column) -> Column:
        return F.coalesce(run, carried)


def _pass(kind: type, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a block, as if its first key began in it: appends the running value."""
    work, before = kind(), ()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, values = (batch.column(batch.schema.get_field_index(n)) for n in names)
        out = work.over(values, _run_starts(keys), before == (keys[0].as_py(),))
        before = (keys[-1].as_py(),)
        yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, RUN])


def _carried(placed: DataFrame, kind: type, key: str) -> list[tuple]:
    """(block, key, value): what the first key of a block brings from the blocks before it."""
    at = F.monotonically_increasing_id()
    ends = (
        placed.select(BLOCK, F.col(key).alias("key"), RUN, at.alias("at")).groupBy(BLOCK)
        .agg(F.min_by(F.struct("key"), "at").alias("first"), F.max_by(F.struct("key", RUN), "at").alias("last"))
        .collect()  # one row per partition
    )
    carry, known = [], None
    for row in sorted(ends, key=lambda r: r[BLOCK]):
        first, (last, value) = row["first"]["key"], row["last"]
        goes_on = known is not None and known[0] == first
        if goes_on:
            carry.append((row[BLOCK], *known))
        known = (last, kind.joined(known[1], value) if goes_on and last == first else value)
    return carry


def _running(
    df: DataFrame, kind: type, key: str, order: Sequence[str], value: str, out: str, blocks: int | None, keep: bool = False
) -> DataFrame:
    """``df`` in ``range_blocks`` of (key, order), with the running ``value`` of each key.

    The pass over a block runs before the blocks are stored, so it is not repeated
    when they are read. Only the first key of a block can have begun in an earlier
    one: blocks tell the driver about their ends, one row each, and get back at
    most one value.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    made = T.LongType() if kind is _Sum else fields[value]
    rows = _in_blocks(df, [key], order, blocks)
    schema = T.StructType([*rows.schema.fields, T.StructField(RUN, made)])
    over = partial(_pass, kind, [key, value])
    # rows that stay placed go on to another pass, which can unpack them
    placed = _store(rows, schema, over) if keep else cut_lineage(rows.mapInArrow(over, schema))
    run = F.col(RUN)
    if carry := _carried(placed, kind, key):
        told = T.StructType([T.StructField("key", fields[key]), T.StructField("value", made)])
        at = {block: (of, brought) for block, of, brought in carry}
        row = [at.get(block) for block in range(max(at) + 1)]  # by block number
        table = df.sparkSession.createDataFrame([(row,)], T.StructType([T.StructField("carry", T.ArrayType(told))]))
        placed = placed.withColumn("_in", F.get(table.scalar(), F.col(BLOCK)))
        goes_on = F.col("_in").isNotNull() & F.col(key).eqNullSafe(F.col("_in.key"))
        run = F.when(goes_on, kind.entered(run, F.col("_in.value"))).otherwise(run)
    filled = placed.withColumn(out, run).drop("_in", RUN)
    return filled if keep else filled.drop(BLOCK)


def running_sum(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str, blocks: int | None = None
) -> DataFrame:
    """``sum(value)``, a whole number, from the key's first row up to the current one."""
    return _running(df, _Sum, key, order, value, out, blocks)


def last_known(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str, blocks: int | None = None
) -> DataFrame:
    """The latest non-null ``value`` of the key up to and including the row."""
    return _running(df, _Last, key, order, value, out, blocks)


def as_of(
    probes: DataFrame,
    changes: DataFrame,
    key: str,
    order: Sequence[str],
    values: Sequence[str],
    strict: bool = False,
    blocks: int | None = None,
    within: Sequence[str] | None = None,
) -> DataFrame:
    """Give each probe the ``values`` of its key's latest change not after it.

    Both sides carry ``key`` and the ``order`` columns. At an equal position the
    change counts as earlier, with ``strict`` as later. Probes without an earlier
    change get NULLs. With ``within``, columns that order the probes of one
    position, the result stays placed on (key, order, within), block number included,
    so that what needs the same order goes on without another shuffle.
    """
    state = F.struct(*[F.col(v) for v in values])
    rank, probe, change = "_rank", 1, 2 if strict else 0
    marked = changes.select(key, *order, F.lit(change).alias(rank), state.alias("_state"))
    merged = probes.withColumn(rank, F.lit(probe)).unionByName(marked, allowMissingColumns=True)
    filled = _running(merged, _Last, key, [*order, rank, *(within or ())], "_state", "_seen", blocks, keep=within is not None)
    return (
        filled.filter(F.col(rank) == probe)
        .select("*", *[F.col(f"_seen.{v}").alias(v) for v in values])
        .drop(rank, "_state", "_seen")
    )


def _sortable(columns: Sequence[pa.Array]) -> np.ndarray:
    """Rows of whole numbers and times as bytes that compare in the same order; NULLs last."""
    out = np.empty((len(columns[0]), len(columns)), ">u8")
    for k, column in enumerate(columns):
        whole = pc.fill_null(column.cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False)
        out[:, k] = whole.view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(columns)}").ravel()


class _History:
    """A short list of changes, looked up by key and position."""

    def __init__(self, changes: pa.Table, key: str, order: Sequence[str], value: str):
        changes = changes.filter(pc.is_valid(changes.column(key))).combine_chunks()
        ids = changes.column(key).to_numpy()
        at = _sortable([changes.column(c).combine_chunks() for c in order])
        self.keys, self.places = np.unique(ids), np.unique(at)
        own = np.searchsorted(self.keys, ids) * (len(self.places) + 1) + np.searchsorted(self.places, at) + 1
        turn = np.argsort(own, kind="stable")
        self.own, self.values = own[turn], changes.column(value).combine_chunks().take(pa.array(turn))

    def seen(self, ids: pa.Array, order: Sequence[pa.Array]) -> pa.Array:
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        whole = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        if not len(self.keys):
            return pa.nulls(len(ids), self.values.type)
        place = np.minimum(np.searchsorted(self.keys, whole), len(self.keys) - 1)
        known = known & (self.keys[place] == whole)
        base = place * (len(self.places) + 1)
        at = np.searchsorted(self.own, base + np.searchsorted(self.places, _sortable(order), "right"), "right") - 1
        known &= (at >= 0) & (self.own[np.maximum(at, 0)] > base)
        return self.values.take(pa.array(np.maximum(at, 0), mask=~known))


def as_of_short(
    probes: DataFrame, changes: DataFrame, key: str, order: Sequence[str], value: str, most: int
) -> DataFrame | None:
    """Like ``as_of`` for one value, without moving the probes; None where ``changes`` has more than ``most`` rows.

    ``key`` and ``order`` are whole numbers or times. The changes go to every task.
    """
    found = changes.select(key, *order, value).limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    sent = probes.sparkSession.sparkContext.broadcast(_History(found, key, order, value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sent.value.seen(batch.column(key), [batch.column(c) for c in order])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, value])

    kind = changes.schema[value].dataType
    return probes.mapInArrow(run, T.StructType([*probes.schema.fields, T.StructField(value, kind)]))


def number_rows(
    df: DataFrame, column: str, start: Column | int, order: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """Consecutive numbers ``start + 1, start + 2, …`` along ``order``.

    The row's position inside its partition comes from the generated id, and the
    partition offsets from a window over one row per partition.
    """
    # low 33 bits: position in the partition; the high bits: the partition
    ordinal = F.monotonically_increasing_id()
    columns = [F.col(c).asc_nulls_last() for c in order]
    spread = df.repartitionByRange(blocks, *columns) if blocks else df.repartitionByRange(*columns)
    placed = cut_lineage(spread.sortWithinPartitions(*columns).withColumn("_ordinal", ordinal))
    placed = placed.withColumn(BLOCK, F.shiftright("_ordinal", 33))
    sizes = placed.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(BLOCK).alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    first = start if isinstance(start, Column) else F.lit(start)
    position = F.col("_ordinal") - F.shiftleft(F.col(BLOCK), 33)
    # one row per partition: bounded by the partition count
    return (
        placed.join(F.broadcast(offsets), F.col(BLOCK) == F.col("_at"))
        .withColumn(column, (first + F.lit(1) + F.col("_offset") + position).cast("long"))
        .drop("_ordinal", BLOCK, "_at", "_offset")
    )
