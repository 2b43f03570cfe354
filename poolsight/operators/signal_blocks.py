"""Segments and their features in one pass over the rows, with one exchange.

Rows are dealt by (layer, block) with the few rows behind a block that lags and flags look at. A task
streams its blocks in order, finds the segments and reduces every piece of a segment to moments: a
segment inside one block is finished there. One that crosses a border leaves a moment row per block;
these rows, a few per block, are joined afterwards. Moments are centred, so that they add up without
cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from poolsight.operators import features, ordered, segments
from poolsight.operators.features import FIT_GRID, FIT_STEP, FFT_ROWS, LAGS
from poolsight.operators.joins import join_on
from poolsight.schema import LAYER, SENSORS, keyed, require
from poolsight.session import cut

#: Cells of one padded matrix of pieces.
CELLS = 1 << 20
WHOLE, TAIL, HEAD = 0, 1, 2

_NUMBERS = ["mean", "m2", "pos_mean", "pos_cov", "low", "high"]
_LISTS = ["lag_head", "lag_tail", "lag_cov", "weighted"]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first `keys` columns."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for i in range(keys):
            codes = batch.column(i).dictionary_encode().indices.to_numpy()
            change |= codes[1:] != codes[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            key = [batch.column(i)[a].as_py() for i in range(keys)]
            if key != now and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            now = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def flags(grouping: str, state: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end flags of rows in order; a missing neighbour or state makes a condition false."""
    before, inside = (int(part) for part in grouping.split("-"))
    missing = np.full(1, np.nan)
    joined = np.diff(idx) == 1
    previous = np.concatenate((missing, np.where(joined, state[:-1], np.nan)))
    following = np.concatenate((np.where(joined, state[1:], np.nan), missing))

    def other(x: np.ndarray) -> np.ndarray:
        return (x != inside) & ~np.isnan(x)

    if before != inside:
        return (previous == before) & (state == inside), (previous == inside) & (state == before)
    return other(previous) & (state == inside), (state == inside) & other(following)


def pieces(idx: np.ndarray, start: np.ndarray, end: np.ndarray, low: int, high: int, min_length: int) -> tuple[np.ndarray, ...]:
    """(kind, first row, stop, limit) of the pieces of a block of rows [low, high); stop -1 where the segment goes on.

    `limit` is the end of the segment as far as the rows behind the block show it.
    """
    beyond = np.iinfo(np.int64).max
    ends = idx[end]
    starts = idx[start & (idx >= low) & (idx < high)]
    following = np.append(ends, beyond)[np.searchsorted(ends, starts, side="right")]
    whole = following <= high
    keep = ~whole | (following - starts >= min_length)
    kind = np.where(whole, WHOLE, TAIL)[keep]
    first, limit = starts[keep], following[keep]
    if low > 0 and len(idx) and idx[-1] >= low:
        after = np.append(ends, beyond)[np.searchsorted(ends, low, side="right")]
        kind, first, limit = np.append(kind, HEAD), np.append(first, low), np.append(limit, after)
    return kind, first, np.where(limit <= high, limit, -1), limit


def moments(values: np.ndarray, first: np.ndarray, count: np.ndarray, limit: np.ndarray, grid: Sequence[float]) -> dict[str, np.ndarray]:
    """Moments of pieces of a signal, given by first place, number of rows and the place before which lagged partners lie."""
    n = len(first)
    out = {c: np.zeros(n) for c in _NUMBERS}
    out |= {"bad": np.zeros(n, bool), "lag_n": np.zeros((n, LAGS), np.int64), "weighted": np.zeros((n, len(grid)))}
    out |= {c: np.zeros((n, LAGS)) for c in _LISTS[:3]}
    order = np.argsort(count, kind="stable")
    at = 0
    while at < n:
        longest = max(int(count[order[at]]), 1)
        size = max(1, CELLS // (longest + LAGS))
        part = order[at : at + size]
        while len(part) > 1 and (int(count[part[-1]]) + LAGS) * len(part) > 2 * CELLS:
            part = part[: len(part) // 2]
        at += len(part)
        width = int(count[part[-1]])
        place = first[part, None] + np.arange(width + LAGS)
        known = (place < limit[part, None]) & (place < len(values))
        x = np.where(known, values[np.minimum(place, len(values) - 1)], 0.0)
        row = np.arange(width)[None, :] < count[part, None]
        here, many = np.where(row, x[:, :width], 0.0), count[part].astype(float)
        bad = (~np.isfinite(here)).any(axis=1)
        here[bad], x[bad] = 0.0, 0.0
        mean = here.sum(axis=1) / many
        centred = np.where(row, here - mean[:, None], 0.0)
        pos_mean = (many - 1) / 2
        out["bad"][part], out["mean"][part], out["pos_mean"][part] = bad, mean, pos_mean
        out["m2"][part] = (centred**2).sum(axis=1)
        out["pos_cov"][part] = (centred * (np.arange(width)[None, :] - pos_mean[:, None])).sum(axis=1)
        out["low"][part] = np.where(row, here, np.inf).min(axis=1)
        out["high"][part] = np.where(row, here, -np.inf).max(axis=1)
        for k in range(1, LAGS + 1):
            pair = row & known[:, k : k + width]
            pairs = pair.sum(axis=1)
            some = np.maximum(pairs, 1)
            late = np.where(pair, x[:, k : k + width], 0.0)
            late[~np.isfinite(late)] = 0.0  # the segment is bad in the block that holds the value
            early = np.where(pair, here, 0.0)
            head, tail = early.sum(axis=1) / some, late.sum(axis=1) / some
            out["lag_n"][part, k - 1], out["lag_head"][part, k - 1], out["lag_tail"][part, k - 1] = pairs, head, tail
            out["lag_cov"][part, k - 1] = ((early - head[:, None]) * (late - tail[:, None]) * pair).sum(axis=1)
        if len(grid):
            out["weighted"][part] = here @ np.exp(np.arange(width)[:, None] * FIT_STEP / np.array(grid)[None, :])
    return out


def _peaks(values: np.ndarray, first: np.ndarray, count: np.ndarray, wanted: np.ndarray, digits: int) -> np.ndarray:
    """First largest |rfft| bin, rounded, of the wanted pieces; 0 for the others."""
    out = np.zeros(len(first), np.int64)
    for n in np.unique(count[wanted]):
        for at in np.array_split(np.flatnonzero(wanted & (count == n)), max(1, int(n) * int((wanted & (count == n)).sum()) // CELLS)):
            if len(at):
                rows = values[first[at, None] + np.arange(n)]
                out[at] = np.round(np.abs(np.fft.rfft(rows, axis=1)), digits).argmax(axis=1)
    return out


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def _reduce(grouping: str, sensors: Sequence[str], min_length: int, block_rows: int, grid: Sequence[float]):
    keys = len(LAYER) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, keys):
            block = rows.column(keys - 1)[0].as_py()
            idx = rows.column("idx").to_numpy()
            state = rows.column("_state").to_numpy(zero_copy_only=False).astype(float)
            low, high = block * block_rows, (block + 1) * block_rows
            kind, first, stop, limit = pieces(idx, *flags(grouping, state, idx), low, high, min_length)
            places = np.searchsorted(idx, first)
            count = np.minimum(np.searchsorted(idx, np.minimum(limit, high)), len(idx)) - places
            some = count > 0
            kind, first, stop, places, count = kind[some], first[some], stop[some], places[some], count[some]
            if not len(kind):
                continue
            ends = np.searchsorted(idx, limit[some])
            ends = np.where(limit[some] > idx[-1], len(idx) + LAGS, ends)
            for sensor in sensors:
                values = rows.column(sensor).to_numpy(zero_copy_only=False).astype(float)
                found = moments(values, places, count, ends, grid)
                mixed = (found["low"] < 0) & (found["high"] > 0) & ~found["bad"]
                peak = _peaks(values, places, count, mixed & (kind == WHOLE), 6)
                n = len(kind)
                columns = {c: pa.array([rows.column(i)[0].as_py()] * n, rows.schema.field(i).type) for i, c in enumerate([*LAYER, "blk"])}
                columns |= {"kind": pa.array(kind, pa.int32()), "seg_id": pa.array(first), "stop": pa.array(stop), "sensor": pa.array([sensor] * n, pa.string())}
                columns |= {"n": pa.array(count, pa.int64()), "bad": pa.array(found["bad"]), "peak": pa.array(peak)}
                columns |= {c: pa.array(found[c]) for c in _NUMBERS}
                columns |= {"lag_n": _lists(found["lag_n"], pa.int64())}
                columns |= {c: _lists(found[c], pa.float64()) for c in _LISTS}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def block_moments(
    cloud: DataFrame,
    grouping: str = "0-1",
    state: str = "state0",
    sensors: Sequence[str] = tuple(SENSORS),
    min_length: int = segments.MIN_LENGTH,
    block_rows: int = ordered.BLOCK_ROWS,
    grid: Sequence[float] = FIT_GRID,
) -> DataFrame:
    """One row per piece of a segment and sensor; see `pieces` and `moments`."""
    require(cloud, state, *sensors)
    segments.boundary_flags(grouping, state)  # checks the grouping
    if block_rows < LAGS + 2:
        raise ValueError(f"block_rows must be at least {LAGS + 2}")
    rows = keyed(cloud).select(*LAYER, "idx", F.col(state).alias("_state"), *sensors).dropna(subset=[*LAYER, "idx"])
    home, offset = ordered.block_of("idx", block_rows), F.col("idx") % block_rows
    homes = (
        F.when(offset <= LAGS, F.array(home, home - 1))
        .when(offset == block_rows - 1, F.array(home, home + 1))
        .otherwise(F.array(home))
    )
    dealt = rows.withColumn("blk", F.explode(homes)).filter("blk >= 0").select(*LAYER, "blk", "idx", "_state", *sensors)
    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*LAYER, "blk"])
    schema += ", kind int, seg_id long, stop long, sensor string, n long, bad boolean, peak long, "
    schema += ", ".join(f"{c} double" for c in _NUMBERS) + ", lag_n array<long>, " + ", ".join(f"{c} array<double>" for c in _LISTS)
    return (
        dealt.repartition(*LAYER, "blk")
        .sortWithinPartitions(*LAYER, "blk", "idx")
        .mapInArrow(_reduce(grouping, sensors, min_length, block_rows, grid), schema)
    )


def _joined(found: DataFrame, min_length: int, block_rows: int, grid: Sequence[float]) -> DataFrame:
    """Moments of the segments that cross a border, from their pieces."""
    blocks = found.filter(F.col("kind") == HEAD).select(*LAYER, "blk", "stop").distinct()
    down = Window.partitionBy(*LAYER).orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, 0)
    closing = F.min(F.when(F.col("stop") >= 0, F.struct("blk", "stop"))).over(down)
    # blocks number from the last: the nearest closing block is the smallest at or behind this one
    closes = blocks.select(*LAYER, (F.col("blk") - 1).alias("blk"), closing.alias("_close"))
    tails = (
        found.filter(F.col("kind") == TAIL)
        .drop("stop", "peak", "kind")
        .join(closes, [*LAYER, "blk"])
        .filter("_close is not null")
        .withColumn("seg_end", F.col("_close.stop"))
        .filter(F.col("seg_end") - F.col("seg_id") >= min_length)
        .withColumn("_last", F.col("_close.blk"))
        .drop("_close")
    )
    tails = cut(tails)
    moment = ["n", "bad", *_NUMBERS, "lag_n", *_LISTS]
    heads = found.filter(F.col("kind") == HEAD).select(*LAYER, "blk", "sensor", F.struct(*moment).alias("piece"))
    later = tails.select(
        *LAYER, "seg_id", "seg_end", "sensor", F.explode(F.sequence(F.col("blk") + 1, F.col("_last"))).alias("blk")
    ).join(heads, [*LAYER, "blk", "sensor"])
    key = [*LAYER, "seg_id", "seg_end", "sensor"]
    parts = cut(
        tails.select(*key, F.lit(0).cast("long").alias("offset"), F.struct(*moment).alias("piece")).unionByName(
            later.select(*key, (F.col("blk") * block_rows - F.col("seg_id")).alias("offset"), "piece")
        )
    )
    p = lambda name: F.col(f"piece.{name}")
    n, pos = p("n"), p("pos_mean") + F.col("offset")

    def mean_of(weight: Column, value: Column) -> Column:
        total = F.sum(weight)
        return F.when(total > 0, F.sum(weight * value) / F.when(total > 0, total))

    lag = lambda name, k: F.get(p(name), F.lit(k))
    means = [mean_of(n, p("mean")).alias("mean"), mean_of(n, pos).alias("pos")]
    means += [mean_of(lag("lag_n", k), lag(f"lag_{e}", k)).alias(f"{e}{k}") for k in range(LAGS) for e in ("head", "tail")]
    whole = parts.groupBy(*key).agg(F.struct(*means).alias("whole"))
    w = lambda name: F.col(f"whole.{name}")
    sums = [
        F.sum(n).alias("n"),
        F.bool_or(p("bad")).alias("bad"),
        F.max(w("mean")).alias("mean"),
        F.sum(p("m2") + n * F.pow(p("mean") - w("mean"), 2)).alias("m2"),
        F.max(w("pos")).alias("pos_mean"),
        F.sum(p("pos_cov") + n * (p("mean") - w("mean")) * (pos - w("pos"))).alias("pos_cov"),
        F.min(p("low")).alias("low"),
        F.max(p("high")).alias("high"),
        F.array(*[F.sum(lag("lag_n", k)) for k in range(LAGS)]).alias("lag_n"),
        *[F.array(*[F.max(w(f"{e}{k}")) for k in range(LAGS)]).alias(f"lag_{e}") for e in ("head", "tail")],
        F.array(
            *[
                F.sum(
                    lag("lag_cov", k)
                    + lag("lag_n", k) * (lag("lag_head", k) - w(f"head{k}")) * (lag("lag_tail", k) - w(f"tail{k}"))
                )
                for k in range(LAGS)
            ]
        ).alias("lag_cov"),
        F.array(*[F.sum(lag("weighted", j) * F.exp(F.col("offset") * FIT_STEP / F.lit(b))) for j, b in enumerate(grid)])
        .cast("array<double>")
        .alias("weighted"),
    ]
    return join_on(parts, whole, key).groupBy(*key).agg(*sums).withColumn("peak", F.lit(None).cast("long"))


def segment_features(
    cloud: DataFrame,
    grouping: str = "0-1",
    state: str = "state0",
    sensors: Sequence[str] = tuple(SENSORS),
    min_length: int = segments.MIN_LENGTH,
    block_rows: int = ordered.BLOCK_ROWS,
    fit_grid: Sequence[float] = FIT_GRID,
    fft_rows: int = FFT_ROWS,
) -> DataFrame:
    """The rows of `features.feature_table` for the segments of a cloud.

    The cloud is read and exchanged once. Only signals of mixed sign that cross a block border are
    looked up again, for their spectrum.
    """
    grid = list(fit_grid)
    found = cut(block_moments(cloud, grouping, state, sensors, min_length, block_rows, grid))
    key = [*LAYER, "seg_id", "seg_end", "sensor"]
    shape = [*key, "n", "bad", *_NUMBERS, "lag_n", *_LISTS, "peak"]
    done = found.filter(F.col("kind") == WHOLE).withColumn("seg_end", F.col("stop")).select(*shape)
    crossing = not found.filter(F.col("kind") == TAIL).isEmpty()
    if crossing:
        done = done.unionByName(_joined(found, min_length, block_rows, grid).select(*shape))
    n = F.col("n")
    nth = lambda name, k: F.get(name, F.lit(k - 1))
    sums = done.select(
        *LAYER, "seg_id", "seg_end", "sensor", n.alias("segment_length"), F.col("bad").alias("has_bad"),
        F.col("low").alias("_lowest"), F.col("high").alias("_highest"), "mean", F.sqrt(F.col("m2") / n).alias("std"),
        F.when(n > 1, F.col("pos_cov") / (n * (n * n - 1) / 12)).alias("slope"),
        *[F.when(nth("lag_n", k) > 0, nth("lag_cov", k) / nth("lag_n", k)).alias(f"_cov_{k}") for k in range(1, LAGS + 1)],
        *[nth("lag_head", k).alias(f"_head_{k}") for k in range(1, LAGS + 1)],
        *[nth("lag_tail", k).alias(f"_tail_{k}") for k in range(1, LAGS + 1)],
        "weighted", "peak",
    )
    table = features.finish(sums, True, grid, ["seg_end", "peak"], signs=True)
    if crossing:
        table = cut(table)
        pending = table.filter("peak is null and not has_bad and not one_sign").select(*LAYER, "seg_id", "seg_end", "segment_length")
        if not pending.isEmpty():
            index = cut(pending.distinct().withColumn("length", F.col("segment_length")))
            rows = segments.segment_rows(cloud, index, sensors)
            known = table.filter("peak is null and not has_bad and not one_sign").select(*features.SIGNAL, "segment_length", "has_bad", "one_sign")
            peaks = features.with_spectrum(cut(known), rows, sensors, False, 6, fft_rows).select(*features.SIGNAL, F.col("dominant_freq").alias("_peak"))
            table = table.join(peaks, features.SIGNAL, "left").withColumn("peak", F.coalesce("peak", "_peak"))
    spectrum = F.when(~F.col("bad_signal"), F.coalesce("peak", F.lit(0).cast("long"))).alias("dominant_freq")
    return table.select(*features.SIGNAL, *[spectrum if c == "dominant_freq" else c for c in features.TABLE_ORDER])
