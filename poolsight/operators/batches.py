"""Size-bounded batches of a file manifest, in name order.

A new batch starts where the running size plus the next size would exceed the limit, so each batch
depends on the one before. That chain is not walked file by file over a whole group. Files are cut
into blocks of consecutive names, and every block becomes a function: from the size of the batch that
is open on entry to the number of batches it starts and the size that is open on exit. Once a block
has started a batch at some file, the rest of it no longer depends on the entry, so the function has
one piece per file that may be the first to start one. Functions of consecutive blocks are composed,
many blocks to one until few are left; each block then gets its entry and is replayed once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from poolsight.operators.joins import join_on
from poolsight.session import cut

LIMIT = 100 * 1024**3
#: Files of a block, and blocks whose functions are composed by one task.
BLOCK_ROWS, FAN = 1 << 16, 256

_FUNCTION = "until array<long>, counts array<long>, exits array<long>, total long"


class Transfer(NamedTuple):
    """With `limit - entry` below until[i], and not below until[i - 1], the block starts counts[i] batches and leaves exits[i].

    Beyond the last piece it starts none and adds `total` to the entry.
    """

    until: np.ndarray
    counts: np.ndarray
    exits: np.ndarray
    total: int

    def apply(self, entry: int, limit: int) -> tuple[int, int]:
        at = int(np.searchsorted(self.until, limit - entry, side="right"))
        return (int(self.counts[at]), int(self.exits[at])) if at < len(self.until) else (0, entry + self.total)

    def then(self, other: Transfer, limit: int) -> Transfer:
        """This block followed by another."""
        after = [other.apply(int(e), limit) for e in self.exits]
        later = other.until + self.total > (self.until[-1] if len(self.until) else -1)
        until = np.concatenate((self.until, (other.until + self.total)[later]))
        counts = np.concatenate((self.counts + np.array([c for c, _ in after], np.int64), other.counts[later]))
        exits = np.concatenate((np.array([e for _, e in after], np.int64), other.exits[later]))
        return Transfer(until, counts, exits, self.total + other.total).short(limit)

    def short(self, limit: int) -> Transfer:
        """Without the pieces that no entry reaches; neighbours of equal outcome are one."""
        keep = np.concatenate(([True], self.until[:-1] <= limit)) if len(self.until) else np.zeros(0, bool)
        until, counts, exits = self.until[keep], self.counts[keep], self.exits[keep]
        last = np.ones(len(until), bool)
        last[:-1] = (counts[1:] != counts[:-1]) | (exits[1:] != exits[:-1])
        return Transfer(until[last], counts[last], exits[last], self.total)


def starts_after(sizes: np.ndarray, limit: int) -> np.ndarray:
    """For a batch that starts with file i, the place of the file that starts the next one."""
    until = np.cumsum(sizes)
    return np.maximum(np.searchsorted(until, until - sizes + limit, side="right"), np.arange(1, len(sizes) + 1))


def transfer(sizes: np.ndarray, limit: int) -> Transfer:
    """The function of a block of files."""
    until, following, n = np.cumsum(sizes), starts_after(sizes, limit).tolist(), len(sizes)
    counts, exits = [1] * n, (until[-1] - until + sizes).tolist()
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            counts[i], exits[i] = counts[following[i]] + 1, exits[following[i]]
    return Transfer(until, np.array(counts, np.int64), np.array(exits, np.int64), int(until[-1])).short(limit)


def replay(sizes: np.ndarray, limit: int, entry: int, batch: int) -> np.ndarray:
    """The batch of every file of a block."""
    following = starts_after(sizes, limit)
    starts, at = np.zeros(len(sizes), np.int64), int(np.searchsorted(np.cumsum(sizes), limit - entry, side="right"))
    while at < len(sizes):
        starts[at] = 1
        at = int(following[at])
    return batch + np.cumsum(starts)


def size_batches(
    files: DataFrame,
    limit: int = LIMIT,
    keys: Sequence[str] = ("grp",),
    name: str = "name",
    size: str = "size",
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Adds `batch`. A first file above the limit leaves batch 0 empty; a null size counts as 0.

    Rows are written once, whatever the number of batches.
    """
    keys = list(keys)
    filled = files.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    ordered = filled.repartitionByRange(*keys, name).sortWithinPartitions(*keys, name)
    more = [T.StructField("_blk", T.LongType()), T.StructField("_at", T.IntegerType())]
    placed = cut(ordered.mapInArrow(_cut_blocks(keys, block_rows), T.StructType([*filled.schema.fields, *more])))
    block = [*keys, "_blk"]
    types = dict(placed.dtypes)
    key_types = ", ".join(f"`{k}` {types[k]}" for k in block)

    def function_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        return _function_row(rows, block, transfer(rows["_size"].to_numpy(), limit))

    functions = placed.select(*block, "_at", "_size").groupBy(*block).applyInArrow(function_of, f"{key_types}, {_FUNCTION}")
    down = Window.partitionBy(*keys).orderBy("_blk")
    numbered = cut(functions.withColumn("_no", (F.row_number().over(down) - 1).cast("long")))
    entries = _entries(numbered, keys, limit, fan)
    shape = T.StructType([*files.schema.fields, T.StructField("batch", T.LongType())])

    def batches_of(rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        found = replay(rows["_size"].to_numpy(), limit, entry["entry"][0].as_py(), entry["batch"][0].as_py())
        return rows.drop_columns(["_size", "_blk", "_at"]).append_column("batch", pa.array(found))

    return placed.groupBy(*block).cogroup(entries.select(*block, "entry", "batch").groupBy(*block)).applyInArrow(batches_of, shape)


def _cut_blocks(keys: Sequence[str], block_rows: int):
    """Number blocks along sorted rows; a block holds rows of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, last = TaskContext.get().partitionId() << 32, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            key = [batch.column(k)[0].as_py() for k in keys]
            change[0] = last is not None and key != last
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            number, place = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int32)
            for i, new in enumerate(change.tolist()):
                at += 1
                if new or at == block_rows:
                    block, at = block + 1, 0
                number[i], place[i] = block, at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(place)], [*batch.schema.names, "_blk", "_at"])

    return run


def _function_row(rows: pa.Table, names: Sequence[str], found: Transfer) -> pa.Table:
    one = rows.select(list(names)).slice(0, 1)
    for field in ("until", "counts", "exits"):
        one = one.append_column(field, pa.array([getattr(found, field)], pa.list_(pa.int64())))
    return one.append_column("total", pa.array([found.total], pa.int64()))


def _functions(rows: pa.Table) -> Iterator[Transfer]:
    for i in range(rows.num_rows):
        lists = [rows[c][i].values.to_numpy() for c in ("until", "counts", "exits")]
        yield Transfer(*lists, rows["total"][i].as_py())


def _entries(functions: DataFrame, keys: list[str], limit: int, fan: int) -> DataFrame:
    """Adds `entry` and `batch`, the open size and batch number before each block (numbered by `_no`)."""
    many = functions.agg(F.max("_no")).first()[0]
    above = functions.withColumn("_up", F.expr(f"_no div {fan}L"))
    if many is None or many < fan:
        started = above.withColumns({"entry": F.lit(0).cast("long"), "batch": F.lit(0).cast("long")})
    else:
        group = [*keys, "_up"]
        types = dict(above.dtypes)

        def composed(rows: pa.Table) -> pa.Table:
            rows, whole = rows.sort_by("_no"), None
            for found in _functions(rows):
                whole = found if whole is None else whole.then(found, limit)
            return _function_row(rows, group, whole)

        upper = above.groupBy(*group).applyInArrow(composed, ", ".join(f"`{k}` {types[k]}" for k in group) + f", {_FUNCTION}")
        known = _entries(cut(upper.withColumnRenamed("_up", "_no")), keys, limit, fan)
        started = join_on(above, known.select(*keys, F.col("_no").alias("_up"), "entry", "batch"), group)

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_no")
        entry, batch, seen = rows["entry"][0].as_py(), rows["batch"][0].as_py(), []
        for found in _functions(rows):
            seen.append((entry, batch))
            more, entry = found.apply(entry, limit)
            batch += more
        rows = rows.drop_columns(["entry", "batch"])
        return rows.append_column("entry", pa.array([e for e, _ in seen], pa.int64())).append_column("batch", pa.array([b for _, b in seen], pa.int64()))

    return cut(started.groupBy(*keys, "_up").applyInArrow(walk, started.schema)).drop("_up")
