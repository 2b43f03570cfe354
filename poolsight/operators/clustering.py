"""k-means on series: Euclidean, DTW and soft-DTW, by broadcast centroids.

Input is `series_id` and `series array<array<double>>` of one common length. Per iteration
only the centroids travel: each task aligns its series and emits sums per centroid step,
which Spark adds up. All starts advance together in one job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolsight.functions import alignment
from poolsight.operators.joins import join_row
from poolsight.session import cut

SEED = 42
TOLERANCE = 1e-6
#: Parts of the full step that a line search tries.
SHARES = (2.0, 1.5, 1.0, 0.5, 0.25)

#: Iterations and starts of the three methods, in order of preference.
METHODS = {"dtw": (20, 3), "euclidean": (20, 5), "softdtw": (10, 2)}


def prepare(series: DataFrame) -> DataFrame:
    """Write the series once, in enough files that every core gets a share in each iteration."""
    cores = series.sparkSession.sparkContext.defaultParallelism
    return cut(series.repartition(max(cores, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "series_id"))


@dataclass
class SeriesModel:
    """Centroids (k, T, S) with the mean cost per series at each iteration of the chosen start."""

    metric: str
    centroids: np.ndarray
    inertia: float
    history: list[float] = field(default_factory=list)
    #: Share of alignments (series by centroid) that bounds made unnecessary in the passes of the fit.
    skipped: float = 0.0
    #: Number of labels that series have, as the pass that measured the centroids found it.
    labels: int = 0

    def assign(self, series: DataFrame) -> DataFrame:
        """Adds `label` and `cost`, the nearest centroid and the cost of reaching it."""
        shared = series.sparkSession.sparkContext.broadcast(self.centroids)
        metric = self.metric

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                label, cost, _ = alignment.nearest(metric, shared.value, _dense(part.column("series")))
                arrays = [*part.columns, pa.array(label.astype(np.int32)), pa.array(cost)]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "label", "cost"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields)
        return series.mapInArrow(nearest, f"{fields}, label int, cost double")

    def centroid_rows(self, spark) -> DataFrame:
        """Centroids as (label, step, sensor, value) rows."""
        k, steps, sensors = self.centroids.shape
        rows = [
            (label, step, f"sensor{s}", float(self.centroids[label, step, s]))
            for label in range(k)
            for step in range(steps)
            for s in range(sensors)
        ]
        return spark.createDataFrame(rows, "label int, step int, sensor string, value double")


def _dense(column: pa.Array) -> np.ndarray:
    """Equal-length nested lists as one (B, T, S) array, without Python objects."""
    steps = column.flatten()
    values = steps.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), len(steps) // len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to the series of one block, so that what a task computes at once does not grow with its batches."""
    for batch in batches:
        size = alignment.batch_rows(len(batch.column("series")[0]) or 1) if batch.num_rows else 1
        for first in range(0, batch.num_rows, size):
            yield batch.slice(first, size)


def draws(seed: int, starts: int, pick: int) -> Column:
    """One exponential number per start, from a hash of the series, the seed, the start and the pick."""

    def draw(start: int) -> Column:
        text = F.concat_ws("|", "series_id", F.lit(str(seed)), F.lit(str(start)), F.lit(str(pick)))
        place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
        return -F.log((place + 0.5) / F.lit(2.0**52))

    return F.array(*[draw(s) for s in range(starts)])


def _seeds(series: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """k-means++ (Arthur and Vassilvitskii 2007) over all series, all starts in one pass per pick.

    Each series draws an exponential number divided by its squared distance to the picks so far;
    the least one is the pick, which chooses a series with a chance in proportion to that distance.
    A task returns its best series per start.
    """
    spark = series.sparkSession
    picks: list[list[np.ndarray]] = [[] for _ in range(starts)]
    taken: list[set[str]] = [set() for _ in range(starts)]
    kind = series.schema["series"].dataType.simpleString()
    for pick in range(k):
        shared = spark.sparkContext.broadcast((picks, taken))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen, before = shared.value
            for batch in _slices(batches):
                data, ids = _dense(batch.column("series")), batch.column("series_id").to_pylist()
                drawn = batch.column("draws").flatten().to_numpy().reshape(len(data), -1)
                rows = []
                for s in range(len(chosen)):
                    draw = drawn[:, s]
                    if chosen[s]:
                        near = np.min([alignment.costs("euclidean", c, data) for c in chosen[s]], axis=0)
                        draw = np.where(near > 0, draw / np.where(near > 0, near, 1.0), np.inf)
                    order = sorted(np.argsort(draw, kind="stable")[: len(before[s]) + 1].tolist(), key=lambda i: (draw[i], ids[i]))
                    least = draw[order[0]] if order else 0.0
                    if np.isinf(least):  # nothing but copies of the picks: the smallest name that is free
                        order = sorted(range(len(ids)), key=ids.__getitem__)
                    free = next((i for i in order if ids[i] not in before[s]), None)
                    if free is not None:
                        rows.append((s, float(draw[free]), int(free)))
                columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())]
                at = pa.array([r[2] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*columns, batch.column("series_id").take(at), batch.column("series").take(at)],
                    ["start", "draw", "series_id", "series"],
                )

        drawn = series.select(draws(seed, starts, pick).alias("draws"), "series_id", "series")
        found = drawn.mapInArrow(best, f"start int, draw double, series_id string, series {kind}")
        least = found.groupBy("start").agg(F.min_by(F.struct("series_id", "series"), F.struct("draw", "series_id")).alias("s"))
        rows = {r["start"]: r["s"] for r in least.collect()}
        shared.unpersist()
        if not rows:
            raise ValueError("there are no series to cluster" if pick == 0 else f"fewer series than the {k} clusters asked for")
        for s in range(starts):
            picks[s].append(np.array(rows[s]["series"], float))
            taken[s].add(rows[s]["series_id"])
    return np.stack([np.stack(p) for p in picks])


def _step(metric: str, shared, series: DataFrame) -> DataFrame:
    """One E-step: per start and cluster the number of series, cost, alignments, weighted sums (coarse parts), weights, fine parts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        starts, k, steps, sensors = centroids.shape
        count, cost_sum, aligned = np.zeros((starts, k)), np.zeros((starts, k)), np.zeros((starts, k))
        sums, mass = np.zeros((2, starts, k, steps, sensors)), np.zeros((starts, k, steps))
        for part in _slices(batches):
            block = alignment.turn(_dense(part.column("series")))
            for s in range(starts):
                label, cost, begun = alignment.nearest_in(metric, centroids[s], block)
                aligned[s, label[0]] += begun
                for c in range(k):
                    members = np.flatnonzero(label == c)
                    if not len(members):
                        continue
                    count[s, c] += len(members)
                    cost_sum[s, c] += cost[members].sum()
                    coarse, fine, weight = alignment.pull(metric, centroids[s, c], block[:, :, members])
                    sums[0, s, c] += coarse
                    sums[1, s, c] += fine
                    mass[s, c] += weight
        at = [(s, c) for s in range(starts) for c in range(k) if count[s, c]]
        parts = [np.concatenate([sums[0][i].ravel(), mass[i].ravel(), sums[1][i].ravel()]) for i in at]
        columns = {
            "start": pa.array([s for s, _ in at], pa.int32()),
            "label": pa.array([c for _, c in at], pa.int32()),
            "n": pa.array([count[i] for i in at], pa.float64()),
            "cost": pa.array([cost_sum[i] for i in at], pa.float64()),
            "aligned": pa.array([aligned[i] for i in at], pa.float64()),
            "parts": pa.array(parts, pa.list_(pa.float64())),
        }
        yield pa.RecordBatch.from_pydict(columns)

    return series.select("series").mapInArrow(
        partial, "start int, label int, n double, cost double, aligned double, parts array<double>"
    )


@dataclass
class _Measured:
    """Sums over all series for the centroids of one start."""

    centroids: np.ndarray
    size: float
    inertia: float
    aligned: float
    sums: np.ndarray
    mass: np.ndarray
    labels: int

    def moved(self, share: float = 1.0) -> np.ndarray:
        """Centroids moved towards the weighted means, which is against the gradient of the cost.

        The gradient of a (soft) alignment cost by a centroid step is 2 * (mass * step - sums).
        """
        known = self.mass > 0
        target = np.where(known[..., None], self.sums / np.where(known, self.mass, 1.0)[..., None], self.centroids)
        return target if share == 1 else self.centroids + share * (target - self.centroids)


def _measure(metric: str, series: DataFrame, centroids: np.ndarray) -> list[_Measured]:
    """Costs, sums and weights of each start, in one pass."""
    shared = series.sparkSession.sparkContext.broadcast(centroids)
    parts = (
        _step(metric, shared, series)
        .select("start", "label", F.posexplode(F.concat(F.array("n", "cost", "aligned"), "parts")).alias("at", "v"))
        .groupBy("start", "label", "at")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    shared.unpersist()
    _, k, steps, sensors = centroids.shape
    out = []
    for s, of in enumerate(centroids):
        mine = parts[parts["start"] == s]
        head = [mine.loc[mine["at"] == i, "v"].sum() for i in range(3)]
        sums, mass = np.zeros((k, steps, sensors)), np.zeros((k, steps))
        for label, rows in mine.groupby("label"):
            values = rows.sort_values("at")["v"].to_numpy()[3:]
            coarse, mass[label], fine = np.split(values, [steps * sensors, steps * (sensors + 1)])
            sums[label] = (coarse + fine).reshape(steps, sensors)
        out.append(_Measured(of, head[0], head[1] / max(head[0], 1.0), head[2], sums, mass, mine["label"].nunique()))
    return out


def move(series: DataFrame, metric: str, centroids: np.ndarray) -> np.ndarray:
    """One E-step and M-step from given centroids (k, T, S)."""
    return _measure(metric, series, centroids[None])[0].moved()


def fit_from(series: DataFrame, metric: str, centroids: np.ndarray, max_iter: int) -> SeriesModel:
    """k-means from given centroids (starts, k, T, S); the start with the lowest cost wins.

    An M-step moves each centroid step to the weighted mean of the samples aligned with it: the
    plain mean for Euclidean, DTW barycenter averaging (Petitjean et al. 2011), and the same with
    fractional weights for soft-DTW. Starts that have settled take no part in further passes. The
    centroids kept are those whose cost was measured.
    """
    starts = len(centroids)
    history: list[list[float]] = [[] for _ in range(starts)]
    running = list(range(starts))
    best, labels = centroids.copy(), [0] * starts
    begun = possible = 0.0
    for _ in range(max_iter):
        moved = centroids.copy()
        still = []
        for s, found in zip(running, _measure(metric, series, centroids[running])):
            past, inertia = history[s], found.inertia
            begun, possible = begun + found.aligned, possible + found.size * centroids.shape[1]
            if not past or inertia < min(past):
                best[s], labels[s] = centroids[s], found.labels
            past.append(float(inertia))
            if len(past) > 1 and past[-2] - inertia < TOLERANCE * max(1.0, abs(past[-2])):
                continue
            moved[s] = found.moved()
            still.append(s)
        centroids, running = moved, still
        if not running:
            break
    winner = min(range(starts), key=lambda s: float(f"{min(history[s]):.9e}"))
    return SeriesModel(metric, best[winner], min(history[winner]), history[winner], 1 - begun / max(possible, 1.0), labels[winner])


def descend(series: DataFrame, metric: str, centroids: np.ndarray, max_iter: int, shares: Sequence[float] = SHARES) -> SeriesModel:
    """k-means from one start (k, T, S) by line-searched descent of the cost, chiefly for soft-DTW.

    The direction is the gradient of the cost scaled by the weights, along which share 1 is the step of
    `fit_from`. All shares are measured in one pass, and the cheapest is taken, so the cost never rises
    and no step is worse than that one; the run ends where none lowers the cost.
    """
    if 1.0 not in shares:
        raise ValueError("shares must hold 1.0, the full step")
    now = _measure(metric, series, centroids[None])[0]
    history = [float(now.inertia)]
    for _ in range(max_iter - 1):
        tried = _measure(metric, series, np.stack([now.moved(s) for s in shares]))
        best = min(tried, key=lambda m: m.inertia)
        if now.inertia - best.inertia < TOLERANCE * max(1.0, abs(now.inertia)):
            break
        now = best
        history.append(float(now.inertia))
    return SeriesModel(metric, now.centroids, now.inertia, history, labels=now.labels)


def fit(
    series: DataFrame,
    metric: str,
    k: int,
    max_iter: int | None = None,
    starts: int | None = None,
    seed: int = SEED,
    line_search: bool = False,
) -> SeriesModel:
    """k-means from k-means++ starts; with `line_search` the winner's centroids are descended further."""
    if metric not in METHODS:
        raise ValueError(f"no metric '{metric}'; there are {', '.join(METHODS)}")
    default_iter, default_starts = METHODS[metric]
    max_iter, starts = max_iter or default_iter, starts or default_starts
    model = fit_from(series, metric, _seeds(series, k, starts, seed), max_iter)
    return descend(series, metric, model.centroids, max_iter) if line_search else model


def select_model(distinct_labels: dict[str, int]) -> str:
    """The method with the most distinct labels, at least two; earlier methods win ties."""
    ranked = [m for m in METHODS if distinct_labels.get(m, 0) > 1]
    if not ranked:
        raise ValueError("no method found two clusters or more")
    return max(ranked, key=lambda m: (distinct_labels[m], -list(METHODS).index(m)))


@dataclass
class ClusteringRun:
    chosen: str
    models: dict[str, SeriesModel]
    labelled: DataFrame
    failures: dict[str, str]


def cluster_series(series: DataFrame, k: int, seed: int = SEED, settings: dict[str, tuple[int, int]] | None = None) -> ClusteringRun:
    """Fit all three methods, leave out those that the data do not suit, and label the series with the chosen one."""
    series = prepare(series)
    if series.isEmpty():
        raise ValueError("there are no series to cluster")
    models: dict[str, SeriesModel] = {}
    failures: dict[str, str] = {}
    counts: dict[str, int] = {}
    for metric in METHODS:
        max_iter, starts = (settings or {}).get(metric, (None, None))
        try:
            models[metric] = fit(series, metric, k, max_iter, starts, seed)
            counts[metric] = models[metric].labels  # known from its passes, so no series is aligned again for it
        except (ValueError, np.linalg.LinAlgError, FloatingPointError) as error:  # the data do not suit it; the others go on
            failures[metric] = str(error)
    chosen = select_model(counts)
    return ClusteringRun(chosen, models, models[chosen].assign(series), failures)


def assign_euclidean(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid of each flattened vector: points (id, vec), centroids (label, vec)."""
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "vec"))).alias("centres"))
    squared = lambda c: F.aggregate(
        F.zip_with("vec", c["vec"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v
    )
    ranked = join_row(points, packed).select(
        "id",
        F.array_min(
            F.transform("centres", lambda c: F.struct(F.round(squared(c), 9).alias("cost"), c["label"].alias("label")))
        ).alias("best"),
    )
    return ranked.select("id", F.col("best.label").alias("label"), F.col("best.cost").alias("cost"))
