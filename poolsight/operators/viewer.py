"""Session summaries: samples, outlier bounds, extents and density grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolsight.operators import ordered
from poolsight.operators.joins import join_summary
from poolsight.schema import LAYER, keyed

MAX_ROWS = 10_000
BINS = 1000


def systematic_sample(
    cloud: DataFrame,
    max_rows: int = MAX_ROWS,
    keys: Sequence[str] = ("session",),
    order: str = "idx",
    block_rows: int = ordered.BLOCK_ROWS,
    parts: Sequence[str] = ("config", "job", "part", "layer"),
) -> DataFrame:
    """Every step-th row of a session with more than `max_rows` rows, where step = rows // max_rows.

    Rows are numbered (`row_nr`) by those `parts` that the cloud has (`part` also as `subfolder`) and
    then `order`, which may start anew in every layer; without any part, `order` must not repeat inside
    a session. Row numbers come from per-block counts, so a large session is not one task.
    """
    keys = list(keys)
    placed = keyed(cloud) if "part" in parts and "subfolder" in cloud.columns else cloud
    present = [p for p in parts if p not in keys and p in placed.columns]
    numbered = ordered.with_row_index(placed, keys, order, "row_nr", block_rows, present)
    if "part" not in cloud.columns:
        numbered = numbered.drop("part")
    totals = cloud.groupBy(*keys).agg(F.count("*").alias("_rows"))
    step = F.greatest(F.lit(1), F.floor(F.col("_rows") / max_rows))
    return (
        join_summary(numbered, totals, keys, [order])
        .filter((F.col("_rows") <= max_rows) | (F.col("row_nr") % step == 0))
        .drop("_rows")
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], column: str, at: dict[str, float], method: str = "nearest"
) -> DataFrame:
    """Exact quantiles per key from value counts, one row per distinct value instead of per row.

    `nearest` takes the sorted value at position q * (n - 1) rounded half up; `linear`
    interpolates between the two values around that position.
    """
    if method not in ("nearest", "linear"):
        raise ValueError(f"there is no method '{method}'; use 'nearest' or 'linear'")
    keys = list(keys)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    blocked = ordered.range_blocks(counts, keys, [column])
    totals = blocked.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    summed = ordered.running_sum(blocked, keys, column, F.col("_n"), "_until", "blk")
    ranked = join_summary(summed, totals, keys, [column])

    def value_at(position: Column) -> Column:
        here = (F.col("_until") > position) & (F.col("_until") - F.col("_n") <= position)
        return F.max(F.when(here, F.col(column)))

    picks = []
    for name, q in at.items():
        position = (F.col("_total") - 1) * q
        if method == "nearest":
            picks.append(value_at(F.floor(position + 0.5)).alias(name))
        else:
            low, high = value_at(F.floor(position)), value_at(F.ceil(position))
            part = F.max(position - F.floor(position))
            picks.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*picks)


def iqr_filter(
    cloud: DataFrame,
    column: str = "layer",
    keys: Sequence[str] = ("session",),
    reach: float = 3.0,
    method: str = "nearest",
) -> DataFrame:
    """Rows within `reach` interquartile ranges of the quartiles, bounds included."""
    keys = list(keys)
    bounds = quantiles(cloud, keys, column, {"_q1": 0.25, "_q3": 0.75}, method)
    spread = (F.col("_q3") - F.col("_q1")) * reach
    inside = F.col(column).between(F.col("_q1") - spread, F.col("_q3") + spread)
    spread_by = [c for c in ("idx", column) if c in cloud.columns]
    return join_summary(cloud, bounds, keys, spread_by).filter(inside).drop("_q1", "_q3")


def n_unique_all(cloud: DataFrame, columns: Sequence[str], keys: Sequence[str] = tuple(LAYER)) -> DataFrame:
    """Distinct values of every column per layer; null counts as one value."""
    counts = [
        (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}") for c in columns
    ]
    return keyed(cloud).groupBy(*keys).agg(*counts)


def unique_layers(cloud: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Rows and distinct layers per session."""
    per_layer = cloud.groupBy(*keys, "layer").agg(F.count("*").alias("_n"))
    return per_layer.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_layers"))


def extent(cloud: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Smallest and largest x and y in one pass."""
    known = cloud.filter(_usable("x") & _usable("y"))
    return known.groupBy(*keys).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )


def density_grid(cloud: DataFrame, keys: Sequence[str] = ("session",), bins: int = BINS) -> DataFrame:
    """Non-empty cells (bx, by, n) of a bins x bins grid between the extents of each session.

    Cells are closed-open, the last one closed; without any width all rows fall in the last.
    """
    keys = list(keys)
    points = cloud.select(*keys, "x", "y").filter(_usable("x") & _usable("y"))
    placed = join_summary(points, extent(points, keys), keys, ["x", "y"]).select(
        *keys, _bin("x", bins).alias("bx"), _bin("y", bins).alias("by")
    )
    return placed.groupBy(*keys, "bx", "by").agg(F.count("*").alias("n"))


def density_clip(
    grid: DataFrame, keys: Sequence[str] = ("session",), bins: int = BINS, q: float = 0.98
) -> DataFrame:
    """Interpolated percentile of the counts of all cells, empty ones included but never built."""
    keys = list(keys)
    tally = grid.groupBy(*keys, "n").agg(F.count("*").alias("_cells"))
    whole = Window.partitionBy(*keys)
    up_to = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    empty = F.lit(bins * bins) - F.sum("_cells").over(whole)
    ranked = tally.select(*keys, "n", (F.sum("_cells").over(up_to) + empty).alias("_until"), empty.alias("_empty"))
    rank = q * (bins * bins - 1)
    low, part = int(rank), rank - int(rank)

    def at(position: int) -> Column:
        found = F.min(F.when(F.col("_until") > position, F.col("n")))
        return F.when(F.max("_empty") > position, F.lit(0)).otherwise(found).cast("double")

    lower = at(low)
    upper = at(min(low + 1, bins * bins - 1))
    return ranked.groupBy(*keys).agg((lower + (upper - lower) * part).alias("clip"))


def _usable(column: str) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.abs(column) < float("inf")


def _bin(axis: str, bins: int) -> Column:
    low, high = F.col(f"{axis}_min"), F.col(f"{axis}_max")
    width = F.when(high > low, high - low)
    slot = F.floor((F.col(axis) - low) / width * bins)
    return F.coalesce(F.least(F.lit(bins - 1), slot), F.lit(bins - 1)).cast("int")
