"""Positions inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from poolsight.session import cut


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the zero-based position of each row in its group, by `order`.

    Rows are dealt by ranges of (keys, order), so a large group spreads over many tasks; each
    counts inside its range, and one small row per group and range carries the offsets. `keys`
    must not be null. Rows that agree in all of `order` get their positions in any order.
    """
    keys, order = list(keys), list(order)
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_rk_block", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_rk_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_rk_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys, "_rk_block")
        .agg(F.count("*").alias("_rk_n"))
        .select(*keys, "_rk_block", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_offset"))
    )
    return (
        dealt.withColumn("_rk_row", F.row_number().over(inside))
        .join(offsets, [*keys, "_rk_block"])
        .withColumn(name, F.col("_rk_row") - 1 + F.col("_rk_offset"))
        .drop("_rk_block", "_rk_row", "_rk_offset")
    )
