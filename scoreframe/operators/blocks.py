"""Rows packed into arrays by the levels of one factor, for fits that read them again and again.

The factor with the most levels is the inner one: all rows of a level lie in one block, so a
step sums up, solves and subtracts the level within the block, and no value of it is ever
exchanged. The levels of the other factors are the outer ones: a vector with a number for
each is held by the driver and sent to the tasks, which add up into a vector of the same
length. A level with too many rows for one block is an outer one as well, and its rows are
dealt by their first outer level; no block grows with a group.

A block is one row of a written table: its levels' keys, their numbers of rows, and for each
column the values of its rows, sorted by level, the rows of outer levels last.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.operators.joins import left_on
from scoreframe.operators.ordered import number_rows
from scoreframe.session import cut_lineage

#: Rows that one task packs, on average at most, of a block, as far as its last level goes, and of a level that is kept within one.
DEALT, BLOCK, WHOLE = 1 << 18, 1 << 15, 1 << 15
#: Levels of a table that is sent to the rows instead of being joined by shuffle.
SENT = 1 << 19
#: Outer levels in all up to which fits hold their vectors on the driver (128 MB for each vector).
HELD = 1 << 24
#: Numbers of a vector that travel as one row, and bytes of the tasks' vectors up to which the driver adds them.
PART, GATHERED = 1 << 16, 1 << 26
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that the workers need no copy of it

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plain(name: str, kind: str) -> Column:
    """A key column; a negative zero is the same level as zero."""
    return F.col(f"`{name}`") + F.lit(0.0).cast(kind) if kind in ("double", "float") else F.col(f"`{name}`")


def counted(rows: DataFrame, own: list[str]) -> tuple[DataFrame, int, int]:
    """Written (own.., n) for each level, the number of levels and of rows."""
    table = cut_lineage(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")))
    row = table.agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("rows")).first()
    return table, row["levels"], row["rows"] or 0


def numbered(table: DataFrame, own: list[str], first: int) -> DataFrame:
    """The table with ``id``, from ``first`` on, in the order of the keys."""
    return cut_lineage(number_rows(table, own, "__place").withColumn("id", (F.col("__place") + first - 1).cast("bigint")).drop("__place"))


def told(rows: DataFrame, table: DataFrame, size: int, own: list[str], out: str) -> DataFrame:
    """The rows with their level's id as ``out``, NULL where the table has none."""
    names = table.select(*own, F.col("id").alias(out))
    return left_on(rows, F.broadcast(names) if size <= SENT else names, own)


def laid_out(rows: DataFrame, own: dict[str, list[str]], tables: dict[str, DataFrame], sizes: dict[str, int]):
    """(rows with ids of outer levels, the ids' names, each factor's span of ids, its outer levels, the inner factor, the number of ids)."""
    near = max(sizes, key=sizes.get)
    ids, span, outer, first = [], {}, {}, 0
    for i, f in enumerate([*(f for f in own if f != near), near]):
        table = tables[f] if f != near else tables[f].where(F.col("n") > WHOLE)
        count, out = (sizes[f], f"id_{i}") if f != near else (table.count(), "heavy")
        none = F.lit(None).cast("bigint")
        outer[f] = numbered(table, own[f], first) if count else table.withColumn("id", none)
        rows = told(rows, outer[f], count, own[f], out) if count else rows.withColumn(out, none)
        span[f] = slice(first, first + count)
        first += count
        ids += [out] if f != near else []
    return rows, ids, span, outer, near, first


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    try:
        return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    except (pa.ArrowNotImplementedError, pa.ArrowInvalid):
        return np.unique([repr(x) for x in column.to_pylist()], return_inverse=True)[1].astype(np.int64)


def _levels(table: pa.Table, inner: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's level, and the first row of each level."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for name in inner:
        own = _codes(table.column(name))
        code = code * (own.max(initial=0) + 1) + own
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    _, first, level = np.unique(code, return_index=True, return_inverse=True)
    return level, first


def _packed(table: pa.Table, inner: list[str], ids: list[str], values: dict[str, str]):
    """The blocks of a task's rows: levels in the order of their codes, rows of outer levels after the last one."""
    heavy = table.column("heavy").to_numpy()
    known = ~np.isnan(heavy) if heavy.dtype.kind == "f" else np.ones(len(heavy), dtype=bool)
    far, near = np.flatnonzero(known), np.flatnonzero(~known)
    of_near = table.select(inner).take(pa.array(near)) if len(far) else table.select(inner)
    level, first = _levels(of_near, inner) if len(near) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    outer = {c: table.column(c).to_numpy() for c in ids}
    if ids:
        lead = outer[ids[0]]
        order = np.argsort(level * (lead.max() + 1) + lead[near], kind="stable")
    else:
        order = np.argsort(level, kind="stable")
    if ids:
        far = far[np.argsort(lead[far], kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(lead[far])) + 1, len(far))  # an outer level's rows stay together
    else:
        edges = np.arange(1, len(far) + 1)
    near, sizes = near[order], np.bincount(level, minlength=len(first))
    ends, keys = np.cumsum(sizes), of_near.select(inner).take(pa.array(first)).combine_chunks()
    begin = gone = 0  # levels and rows of outer levels that have their block
    while begin < len(sizes) or gone < len(far):
        done = ends[begin - 1] if begin else 0
        end = int(np.searchsorted(ends, done + BLOCK)) + 1 if begin < len(sizes) else begin
        own = near[done:ends[min(end, len(ends)) - 1]] if end > begin else near[:0]
        more = far[:0]
        if end >= len(sizes) and gone < len(far):
            more = far[gone:edges[min(np.searchsorted(edges, gone + BLOCK), len(edges) - 1)]]
            gone += len(more)
        rows, sink = np.concatenate([own, more]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, keys.schema) as stream:
            stream.write_table(keys.slice(begin, end - begin))
        out = {"keys": sink.getvalue().to_pybytes(), "sizes": sizes[begin:end].astype(np.int64).tobytes(), "heavy": heavy[more].astype(np.int32).tobytes()}
        out |= {c: outer[c][rows].astype(np.int32).tobytes() for c in ids}
        yield out | {c: table.column(c).to_numpy()[rows].astype(kind).tobytes() for c, kind in values.items()}
        begin = min(end, len(sizes))


def pack(rows: DataFrame, inner: list[str], ids: list[str], values: dict[str, str], n_rows: int) -> DataFrame:
    """Blocks (keys, sizes, heavy, ids.., values..) of ``rows``, whose column ``heavy`` names the outer level in place of the keys.

    ``values`` are the columns to keep and their numpy types.
    """
    spark = rows.sparkSession
    parts = max(-(-n_rows // DEALT), min(spark.sparkContext.defaultParallelism, -(-n_rows // (1 << 14))), 1)
    salt = F.xxhash64(ids[0]) if ids else F.xxhash64(F.monotonically_increasing_id())
    deal = F.when(F.col("heavy").isNull(), F.xxhash64(*inner)).otherwise(salt)
    columns = ["keys", "sizes", "heavy", *ids, *values]

    def task(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            for packed in _packed(pa.Table.from_batches(found), inner, ids, values):
                yield pa.RecordBatch.from_pydict({c: pa.array([packed[c]], pa.binary()) for c in columns})

    dealt = rows.select(*inner, "heavy", *ids, *values).repartition(parts, deal)
    return cut_lineage(dealt.mapInArrow(task, ", ".join(f"`{c}` binary" for c in columns)))


class Block:
    """One block's arrays; ``types`` are those of the columns read."""

    def __init__(self, row: dict, types: dict[str, str]):
        self.raw = row
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.far = np.frombuffer(row["heavy"], np.int32)
        self.column = {c: np.frombuffer(row[c], kind) for c, kind in types.items()}
        self.near = int(self.sizes.sum())
        self.starts = np.cumsum(self.sizes) - self.sizes

    def by_level(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values by inner level."""
        return np.add.reduceat(values[:self.near], self.starts) if len(self.starts) else np.zeros(0)

    def to_rows(self, levels: np.ndarray) -> np.ndarray:
        """A value for each inner level, at its rows."""
        return np.repeat(levels, self.sizes)

    def keys(self) -> pa.Table:
        return pa.ipc.open_stream(self.raw["keys"]).read_all()


def scatter(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds the values to ``total`` at their places, which may repeat."""
    if len(total) > 2 * len(at):
        np.add.at(total, at, values)
    else:
        total += np.bincount(at, values, len(total))


def _keep_memory() -> None:
    """Arrays of a block are made and dropped all the time: freed memory stays with the process, or each is mapped anew."""
    try:
        import ctypes

        for option, size in ((-1, 1 << 28), (-2, 1 << 23), (-3, 1 << 25)):  # trim threshold, top pad, mmap threshold
            ctypes.CDLL(None).mallopt(option, size)
    except (OSError, AttributeError):
        pass  # another C library


def _batches(batches, types: dict[str, str]):
    _keep_memory()
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row, types)


def run(blocks: DataFrame, types: dict[str, str], shared, work: Callable, width: int, least: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One pass: ``work(block, shared, total)`` adds into a vector of ``width`` numbers and returns a few numbers.

    Gives the sum of the vectors (or their least values) and the blocks' few numbers, a row for each block.
    """
    spark, added = blocks.sparkSession, np.minimum if least else np.add
    sent = spark.sparkContext.broadcast(shared)

    def task(batches):
        given, total, few = sent.value, np.full(width, np.inf if least else 0.0), []
        for block in _batches(batches, types):
            few.append(np.asarray(work(block, given, total), dtype=float))
        if few:
            yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "v": pa.array([np.array(few).tobytes()], pa.binary()), "n": pa.array([len(few)], pa.int32())})
            for k, at in enumerate(range(0, width, PART)):
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "v": pa.array([total[at:at + PART].tobytes()], pa.binary()), "n": pa.array([0], pa.int32())})

    def summed(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table
        return table.slice(0, 1).set_column(1, "v", pa.array([_combined(table, added)], pa.binary()))

    tasks, kind = 2 * spark.sparkContext.defaultParallelism, "part int, v binary, n int"
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "1")  # a batch is one block
    try:
        found = blocks.select("sizes", "heavy", *types).coalesce(tasks).mapInArrow(task, kind)
        if tasks * width * 8 > GATHERED:
            found = found.groupBy("part").applyInArrow(summed, kind)
        found = found.toArrow()
    finally:
        spark.conf.set(BATCH_ROWS, before)
        sent.destroy()
    total, few = np.full(width, np.inf if least else 0.0), []
    for part, v, n in zip(found.column("part").to_pylist(), found.column("v"), found.column("n").to_pylist()):
        own = np.frombuffer(v.as_buffer(), float)
        if part < 0:
            few.append(own.reshape(n, -1))
        else:
            at = slice(part * PART, part * PART + len(own))
            total[at] = added(total[at], own)
    return total, np.concatenate(few) if few else np.zeros((0, 0))


def _combined(table: pa.Table, added) -> bytes:
    out = None
    for v in table.column("v"):
        own = np.frombuffer(v.as_buffer(), float)
        out = own.copy() if out is None else added(out, own)
    return out.tobytes()


def each(blocks: DataFrame, types: dict[str, str], shared, make: Callable, schema: str) -> DataFrame:
    """Written rows that ``make(block, shared)`` gives for each block as an Arrow table."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(shared)

    def task(batches):
        given = sent.value
        for block in _batches(batches, types):
            yield from make(block, given).to_batches()

    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "1")
    try:
        return cut_lineage(blocks.select("sizes", "heavy", *dict.fromkeys([*types, "keys"])).mapInArrow(task, schema))
    finally:
        spark.conf.set(BATCH_ROWS, before)
        sent.destroy()


def held(spark, **columns: np.ndarray) -> DataFrame:
    """A written table of the driver's vectors beside ``id``, counted from 0."""
    size = len(next(iter(columns.values())))
    table = pa.table({"id": np.arange(size, dtype=np.int64), **columns})
    return cut_lineage(spark.createDataFrame(table))


def key_types(rows: DataFrame, names: list[str]) -> str:
    """The schema of the key columns, for tables made from blocks."""
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)
