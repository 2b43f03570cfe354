"""Cutting a layer's signal into segments at transitions of the laser state.

A segment runs from a start row to the first end row strictly after it, and holds the rows
`[start, end)`. `idx`, the position of a row in its layer, is consecutive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolsight.operators import ordered
from poolsight.schema import LAYER, SENSORS, keyed, require

MIN_LENGTH = 10
PIECE_ROWS = 64
GROUPINGS = ("0-1", "1-0", "0-0", "1-1")


def boundary_flags(grouping: str, state: str = "state0") -> tuple[Column, Column]:
    """Start and end conditions over the current, previous and next state.

    With two different states a segment opens on the first kind of change and closes on the
    opposite one. With twice the same state it spans a run, whose last row is the end. A
    comparison with a missing neighbour is unknown, hence false: runs cut off by the edge of
    the layer do not count.
    """
    if grouping not in GROUPINGS:
        raise ValueError(f"there is no grouping '{grouping}'; use one of {', '.join(GROUPINGS)}")
    before, inside = (int(part) for part in grouping.split("-"))
    previous, current, following = F.col(f"prev_{state}"), F.col(state), F.col(f"next_{state}")
    if before != inside:
        start = (previous == before) & (current == inside)
        end = (previous == inside) & (current == before)
    else:
        start = (previous != inside) & (current == inside)
        end = (current == inside) & (following != inside)
    return F.coalesce(start, F.lit(False)), F.coalesce(end, F.lit(False))


def transition_flags(
    cloud: DataFrame, state: str = "state0", block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Neighbouring states and the start/end flags of all four groupings for every row."""
    require(cloud, state)
    rows = keyed(cloud).select(*LAYER, "idx", state)
    flagged = ordered.with_neighbours(rows, LAYER, "idx", state, block_rows).drop("blk")
    for grouping in GROUPINGS:
        start, end = boundary_flags(grouping, state)
        tag = grouping.replace("-", "")
        flagged = flagged.withColumns({f"start_{tag}": start, f"end_{tag}": end})
    return flagged


def segment_index(
    cloud: DataFrame,
    grouping: str = "0-1",
    state: str = "state0",
    min_length: int = MIN_LENGTH,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """One row per segment: layer keys, `seg_id` (= first idx), `seg_end` (exclusive), `length`.

    Reads three things of the cloud: the layer keys, idx and the state.
    """
    require(cloud, state)
    start, end = boundary_flags(grouping, state)
    # named here, the null checks are the same on both uses of the blocks, which then share a shuffle
    rows = keyed(cloud).select(*LAYER, "idx", state)
    for key in (*LAYER, "idx"):
        rows = rows.filter(F.col(key).isNotNull())
    marks = (
        ordered.with_neighbours(rows, LAYER, "idx", state, block_rows)
        .select(*LAYER, "blk", "idx", start.alias("is_start"), end.alias("is_end"))
        .filter("is_start or is_end")
    )
    paired = ordered.next_marked(marks, LAYER, "idx", F.when(F.col("is_end"), F.col("idx")), "seg_end")
    length = F.col("seg_end") - F.col("idx")
    return paired.filter(F.col("is_start") & (length >= min_length)).select(
        *LAYER, F.col("idx").alias("seg_id"), "seg_end", length.alias("length")
    )


def segment_pieces(index: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Segments cut at multiples of `piece_rows`, the equality key of `segment_rows`.

    Two explodes keep the arrays short even for a segment of billions of rows.
    """
    last = F.col("seg_end") - 1
    span = piece_rows * 4096
    spans = index.withColumn("_span", F.explode(F.sequence(_div("seg_id", span), F.expr(f"(seg_end - 1) div {span}L"))))
    low = F.greatest(F.col("seg_id"), F.col("_span") * span)
    high = F.least(last, (F.col("_span") + 1) * span - 1)
    bounded = spans.withColumns({"_low": low, "_high": high})
    pieces = F.explode(F.sequence(_div("_low", piece_rows), _div("_high", piece_rows)))
    return bounded.withColumn("piece", pieces).drop("_span", "_low", "_high")


def segment_rows(
    cloud: DataFrame,
    index: DataFrame,
    values: Sequence[str] = tuple(SENSORS),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Long form: one row per segment and position, also where segments overlap.

    Rows and segments meet on (layer, piece). A piece has at most `piece_rows` rows, so the
    join spreads evenly whatever the size of a layer or a segment.
    """
    rows = keyed(cloud).select(*LAYER, "idx", *values).withColumn("piece", _div("idx", piece_rows))
    inside = (F.col("idx") >= F.col("seg_id")) & (F.col("idx") < F.col("seg_end"))
    return (
        rows.join(segment_pieces(index, piece_rows), [*LAYER, "piece"])
        .filter(inside)
        .select(*LAYER, "seg_id", "length", (F.col("idx") - F.col("seg_id")).alias("pos"), *values)
    )


def segments_per_group(cloud: DataFrame, index: DataFrame) -> DataFrame:
    """Number of segments per layer, zero where a layer has none."""
    layers = keyed(cloud).select(*LAYER).distinct()
    counts = index.groupBy(*LAYER).agg(F.count("*").alias("n_segments"))
    return layers.join(counts, LAYER, "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))


def segment_arrays(
    rows: DataFrame, part_rows: int, values: Sequence[str] = tuple(SENSORS)
) -> DataFrame:
    """Segments as `array<struct<values>>` in position order, in parts of `part_rows` positions.

    Every segment comes as parts `seg_part` 0, 1, ... of which all but the last are full, so
    arrays stay bounded and the segment whole; the caller names the bound.
    """
    item = F.struct("pos", *values)
    collected = rows.groupBy(*LAYER, "seg_id", "length", _div("pos", part_rows).alias("seg_part")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    bare = F.transform("items", lambda s: F.struct(*[s[v].alias(v) for v in values]))
    return collected.select(*LAYER, "seg_id", "length", "seg_part", bare.alias("samples"))


def _div(column: str, by: int) -> Column:
    return F.expr(f"`{column}` div {by}L")
