"""Work that depends on row order, without putting a whole group into one task.

Every operator here takes an integer order column and cuts each group into blocks of
`block_rows` consecutive order values. Windows run inside a block; what crosses a block
border is carried by a summary with one row per block. A group that holds a third of a
10^12-row table therefore spreads over a million blocks, and only its summary rows (a few
numbers each) meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolsight.operators.joins import join_on
from poolsight.session import cut

BLOCK_ROWS = 1 << 18


def block_of(order: str, block_rows: int) -> Column:
    return F.expr(f"`{order}` div {block_rows}L")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    block_rows: int = BLOCK_ROWS,
    block: str = "blk",
) -> DataFrame:
    """Add `prev_<value>` and `next_<value>`, null at the two ends of a group.

    `order` must be consecutive inside a group. The first and last row of a block are also
    sent to the adjacent block, so one shuffle by (keys, block) is enough. The block column
    stays in the result, which is partitioned by it.
    """
    if block_rows < 2:
        raise ValueError("block_rows must be at least 2")
    home = block_of(order, block_rows)
    offset = F.col(order) % block_rows
    homes = (
        F.when(offset == 0, F.array(home, home - 1))
        .when(offset == block_rows - 1, F.array(home, home + 1))
        .otherwise(F.array(home))
    )
    within = Window.partitionBy(*keys, block).orderBy(order)
    return (
        df.withColumn(block, F.explode(homes))
        .withColumn(f"prev_{value}", F.lag(value).over(within))
        .withColumn(f"next_{value}", F.lead(value).over(within))
        .filter(F.col(block) == home)
    )


def next_marked(
    rows: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    at: Column,
    name: str,
    block: str = "blk",
    null_keys: bool = False,
) -> DataFrame:
    """Forward as-of lookup: the first non-null `at` of the rows after the current one.

    `block` numbers consecutive blocks of `order`, along which `at` never falls. The descending
    frame ends one row before the current one; a frame of following rows would be quadratic.
    Rows with null keys are looked up too with `null_keys`, at the price of one more shuffle.
    """
    order = [order] if isinstance(order, str) else list(order)
    before = (Window.unboundedPreceding, -1)
    local = Window.partitionBy(*keys, block).orderBy(*[F.desc(c) for c in order]).rowsBetween(*before)
    blocks = rows.groupBy(*keys, block).agg(F.min(at).alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc(block)).rowsBetween(*before)
    carry = blocks.select(*keys, block, F.last("_first", ignorenulls=True).over(later).alias("_carry"))
    marked = rows.withColumn("_local", F.last(at, ignorenulls=True).over(local))
    carried = join_on(marked, carry, [*keys, block], "left") if null_keys else marked.join(carry, [*keys, block], "left")
    return (
        carried
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry")
    )


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str = "blk") -> DataFrame:
    """Number blocks by range partition, for an order that is no dense integer.

    The result is written once: partition numbers have to stay the same for every reader.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return cut(ranged.withColumn(block, F.spark_partition_id()))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: Column,
    name: str,
    block: str,
) -> DataFrame:
    """Inclusive running sum in `order`, given a column that numbers consecutive blocks."""
    order = [order] if isinstance(order, str) else list(order)
    local = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_total"))
    offsets = totals.select(
        *keys, block, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        join_on(df.withColumn("_run", F.sum(value).over(local)), offsets, [*keys, block])
        .withColumn(name, F.col("_run") + F.col("_offset"))
        .drop("_run", "_offset")
    )


def with_row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "row_nr",
    block_rows: int = BLOCK_ROWS,
    parts: Sequence[str] = (),
) -> DataFrame:
    """Zero-based position of each row in its group, by `parts` and then `order`.

    `order` may have gaps but no repeats inside a part. Blocks are cut inside each part, so a
    block never holds more than `block_rows` rows, also where `order` starts anew in every part.
    Null keys and parts count as values; null parts come first.
    """
    keys, parts = list(keys), list(parts)
    blocked = df.withColumn("_blk", block_of(order, block_rows))
    cell = [*keys, *parts, "_blk"]
    local = Window.partitionBy(*cell).orderBy(order)
    earlier = Window.partitionBy(*keys).orderBy(*parts, "_blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy(*cell).agg(F.count("*").alias("_count"))
    offsets = counts.select(*cell, F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"))
    numbered = join_on(blocked.withColumn("_row", F.row_number().over(local)), offsets, cell)
    return numbered.withColumn(name, (F.col("_row") - 1 + F.col("_offset")).cast("long")).drop("_blk", "_row", "_offset")
