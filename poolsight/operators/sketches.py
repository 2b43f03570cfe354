"""Opt-in approximate counts and quantiles from sketches that are stored once and merged.

Exact results are the default (`viewer.n_unique_all`, `viewer.quantiles`). A sketch row per layer, made
in one pass, answers for layers, jobs, configurations and sessions without reading points again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolsight.operators.joins import join_summary
from poolsight.schema import LAYER, keyed

#: 2^14 registers: a standard error of 1.04 / 2^7 = 0.8 %, so that 3 % is off by chance once in 5,000 counts.
REGISTERS = 14
DISTINCT_ERROR = 0.03
#: Size of a quantile summary, and the share of all rows by which the rank of its answers may be off.
SUMMARY, RANK_ERROR = 800, 0.01


def layer_sketches(
    cloud: DataFrame, distinct: Sequence[str] = (), quantiles: Sequence[str] = (), keys: Sequence[str] = tuple(LAYER)
) -> DataFrame:
    """One row per layer: rows, per column of `distinct` a sketch of its values and whether it has nulls, per
    column of `quantiles` a summary of its finite values. Write it, and merge it as often as needed.
    """
    columns = [F.count("*").alias("n_rows")]
    for c in distinct:
        # the hash leaves out nulls, and makes one kind of sketch for all types
        columns.append(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), REGISTERS).alias(f"distinct_{c}"))
        columns.append(F.max(F.col(c).isNull()).alias(f"nulls_{c}"))
    for c in quantiles:
        value = F.col(c).cast("double")
        columns.append(F.kll_sketch_agg_double(F.when(F.abs(value) < float("inf"), value), SUMMARY).alias(f"quantiles_{c}"))
    return keyed(cloud).groupBy(*keys).agg(*columns)


def n_unique_approx(sketches: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("session",)) -> DataFrame:
    """Distinct values of every column, null counting as one, off by `DISTINCT_ERROR` at most but for rare chance."""
    merged = [
        (F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}")) + F.max(F.col(f"nulls_{c}")).cast("long")).alias(f"n_{c}")
        for c in columns
    ]
    return sketches.groupBy(*keys).agg(*merged)


def quantiles_approx(sketches: DataFrame, column: str, at: dict[str, float], keys: Sequence[str] = ("session",)) -> DataFrame:
    """Values whose rank is off by `RANK_ERROR` of all rows at most but for rare chance; null without finite values."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double(f"quantiles_{column}").alias("_summary"))
    some = F.kll_sketch_get_n_double("_summary") > 0

    def value(q: float) -> Column:
        return F.when(some, F.kll_sketch_get_quantile_double("_summary", F.lit(float(q))))

    return merged.select(*keys, *[value(q).alias(name) for name, q in at.items()])


def iqr_filter_approx(
    cloud: DataFrame, sketches: DataFrame, column: str = "layer", keys: Sequence[str] = ("session",), reach: float = 3.0
) -> DataFrame:
    """`viewer.iqr_filter` with quartiles from stored sketches; rows near a bound may fall on its other side."""
    bounds = quantiles_approx(sketches, column, {"_q1": 0.25, "_q3": 0.75}, keys)
    spread = (F.col("_q3") - F.col("_q1")) * reach
    inside = F.col(column).between(F.col("_q1") - spread, F.col("_q3") + spread)
    spread_by = [c for c in ("idx", column) if c in cloud.columns]
    return join_summary(cloud, bounds, list(keys), spread_by).filter(inside).drop("_q1", "_q3")
