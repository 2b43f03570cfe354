"""Segments as fixed-length multivariate series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolsight.functions.scalars import let
from poolsight.operators.segments import segment_rows
from poolsight.schema import LAYER, SENSORS, keyed

TARGET_LENGTH = 100
SEGMENT_CAP = 1000


def segment_cap(index: DataFrame, n_segments: int, cap: int = SEGMENT_CAP) -> DataFrame:
    """The first min(cap, n_segments) segments in key order, which is the same on every run."""
    return index.orderBy(*LAYER, "seg_id").limit(min(cap, n_segments))


def series_id() -> Column:
    return F.concat_ws("/", *LAYER, "seg_id")


def pad_or_truncate(
    rows: DataFrame, target_length: int = TARGET_LENGTH, sensors: Sequence[str] = tuple(SENSORS)
) -> DataFrame:
    """Series of exactly `target_length` samples: the tail cut, or the last sample repeated.

    Rows beyond the target are dropped before the shuffle, so arrays stay bounded.
    """
    item = F.struct("pos", F.array(*sensors).alias("sample"))
    arrays = (
        rows.filter(F.col("pos") < target_length)
        .groupBy(*LAYER, "seg_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    samples = F.col("items.sample")
    padding = F.array_repeat(F.element_at(samples, -1), F.lit(target_length) - F.size(samples))
    return arrays.select(*LAYER, "seg_id", series_id().alias("series_id"), F.concat(samples, padding).alias("series"))


def zscore_series(series: DataFrame, sensors: Sequence[str] = tuple(SENSORS)) -> DataFrame:
    """Each series and sensor scaled to mean 0 and population std 1; std 0 counts as 1."""
    n = len(sensors)
    means = F.array(*[_mean("series", _nth(i)) for i in range(n)])

    def with_means(m: Column) -> Column:
        stds = F.array(*[F.sqrt(_mean("series", _squared_gap(i, m))) for i in range(n)])
        return let(stds, lambda s: F.transform("series", lambda x: _scaled(x, m, s)))

    def _scaled(x: Column, m: Column, s: Column) -> Column:
        return F.array(*[(x[i] - m[i]) / F.when(s[i] > 0, s[i]).otherwise(F.lit(1.0)) for i in range(n)])

    return series.withColumn("series", let(means, with_means)).select(*series.columns)


def _mean(column: str, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda total, sample: total + of(sample)) / F.size(column)


def _nth(i: int) -> Callable[[Column], Column]:
    return lambda sample: sample[i]


def _squared_gap(i: int, means: Column) -> Callable[[Column], Column]:
    return lambda sample: (sample[i] - means[i]) * (sample[i] - means[i])


def unfold(series: DataFrame, keys: Sequence[str], sensors: Sequence[str] = tuple(SENSORS)) -> DataFrame:
    """One row per series and time step, one column per sensor."""
    steps = series.select(*keys, F.posexplode("series").alias("step", "sample"))
    return steps.select(*keys, "step", *[F.col("sample")[i].alias(s) for i, s in enumerate(sensors)])


def cluster_sample(labelled: DataFrame, per_cluster: int = 10, key: str = "series_id") -> DataFrame:
    """The first `per_cluster` members of each cluster in key order.

    The rank filter is applied to every partition before the shuffle, so a cluster of any
    size sends at most `per_cluster` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("label").orderBy(key))
    return labelled.withColumn("rank", rank).filter(F.col("rank") <= per_cluster)


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def scaled_segments(cloud: DataFrame, index: DataFrame, target_length: int, cap: int | None = None) -> DataFrame:
    """Scaled series of all segments, or of the first `cap`: the input of clustering."""
    chosen = index if cap is None else segment_cap(index, cap, cap)
    return zscore_series(pad_or_truncate(segment_rows(keyed(cloud), chosen), target_length))
