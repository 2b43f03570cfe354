import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolsight.functions import alignment
from poolsight.operators import clustering, scores, series


def naive_dtw(a, b):
    n, m = len(a), len(b)
    table = np.full((n + 1, m + 1), np.inf)
    table[0, 0] = 0
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        cost = ((a[i - 1] - b[j - 1]) ** 2).sum()
        table[i, j] = cost + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
    return table[n, m]


def test_dtw_cost_and_path():
    rng = np.random.default_rng(0)
    centroid, batch = rng.normal(size=(9, 2)), rng.normal(size=(5, 9, 2))
    costs = alignment.costs("dtw", centroid, batch)
    assert costs == pytest.approx([naive_dtw(centroid, x) for x in batch])
    w = alignment.weights("dtw", centroid, batch)
    # the path's own cost is the cheapest cost, and it moves by single steps
    assert (w * alignment.local_cost(centroid, batch)).sum(axis=(1, 2)) == pytest.approx(costs)
    for path in w:
        cells = np.argwhere(path)
        assert (cells[0] == 0).all() and (cells[-1] == 8).all()
        assert (np.abs(np.diff(cells, axis=0)).max(axis=1) == 1).all()


def test_soft_weights_are_the_gradient():
    rng = np.random.default_rng(1)
    cost = rng.random((2, 5, 5))
    for gamma in (1.0, 0.1):
        w = alignment.soft_weights(alignment.soft_table(cost, gamma), cost, gamma)
        for b, i, j in itertools.product(range(2), range(5), range(5)):
            up, down = cost.copy(), cost.copy()
            up[b, i, j] += 1e-6
            down[b, i, j] -= 1e-6
            slope = (alignment.soft_table(up, gamma)[b, -1, -1] - alignment.soft_table(down, gamma)[b, -1, -1]) / 2e-6
            assert w[b, i, j] == pytest.approx(slope, abs=1e-5)


@pytest.fixture(scope="module")
def waves(spark):
    """Three shapes, twelve noisy copies each."""
    rng = np.random.default_rng(7)
    t = np.linspace(0, 1, 12)
    shapes = [np.stack([np.sin(6 * t), t]), np.stack([3 - 5 * t, -t]), np.stack([5 * t * t, np.cos(9 * t)])]
    rows = [
        (f"{kind}-{i:02d}", (shape + rng.normal(scale=0.05, size=shape.shape)).T.tolist())
        for kind, shape in enumerate(shapes)
        for i in range(12)
    ]
    return spark.createDataFrame(rows, "series_id string, series array<array<double>>").repartition(5)


@pytest.mark.parametrize("metric", list(clustering.METHODS))
def test_recovers_separate_groups(waves, metric):
    model = clustering.fit(waves, metric, 3)
    labels = {r.series_id: r.label for r in model.assign(waves).collect()}
    groups = [{labels[f"{kind}-{i:02d}"] for i in range(12)} for kind in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    if metric == "dtw":
        assert all(b <= a + 1e-9 for a, b in zip(model.history, model.history[1:]))
    again = clustering.fit(waves, metric, 3)
    assert np.allclose(model.centroids, again.centroids)
    assert len(model.centroid_rows(waves.sparkSession).collect()) == 3 * 12 * 2


def test_choice_of_method():
    assert clustering.select_model({"dtw": 2, "euclidean": 3, "softdtw": 3}) == "euclidean"
    assert clustering.select_model({"softdtw": 2, "dtw": 2}) == "dtw"
    with pytest.raises(ValueError):
        clustering.select_model({"dtw": 1})
    with pytest.raises(ValueError):
        clustering.fit(None, "other", 2)


def test_run_skips_failures_and_needs_series(spark, waves):
    run = clustering.cluster_series(waves, 3, settings={"dtw": (3, 1), "softdtw": (3, 1), "euclidean": (5, 2)})
    assert run.chosen == "dtw" and not run.failures
    assert run.labelled.count() == 36
    with pytest.raises(ValueError):
        clustering.cluster_series(waves.filter("series_id = ''"), 3)


def test_scores_golden_and_tiled(spark):
    points = spark.createDataFrame(
        [(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [12.0], 1)], "id long, vec array<double>, label int"
    )
    for tile_rows in (1, 2, 100):
        assert scores.quadratic_silhouette(points, tile_rows).first().silhouette == pytest.approx(0.856163, abs=1e-6)
    assert scores.calinski_harabasz(points).first().calinski_harabasz == pytest.approx(88.2)
    lone = points.unionByName(spark.createDataFrame([(4, [50.0], 2)], points.schema))
    # a cluster of one scores 0
    assert scores.quadratic_silhouette(lone).first().silhouette == pytest.approx(0.856163 * 4 / 5, abs=1e-6)


def test_pad_zscore_and_samples(spark):
    rows = [("s", "c", "j", -1, 30, seg, pos, float(pos + 1), 7.0) for seg, n in ((0, 3), (1, 7)) for pos in range(n)]
    df = spark.createDataFrame(
        rows, "session string, config string, job string, part int, layer int, seg_id long, pos long, sensor0 double, sensor1 double"
    )
    padded = series.pad_or_truncate(df, 5).orderBy("seg_id")
    assert [[x[0] for x in r.series] for r in padded.collect()] == [[1, 2, 3, 3, 3], [1, 2, 3, 4, 5]]
    scaled = np.array(series.zscore_series(padded).orderBy("seg_id").first().series)
    assert scaled[:, 0].mean() == pytest.approx(0) and scaled[:, 0].std() == pytest.approx(1)
    assert (scaled[:, 1] == 0).all()
    labelled = spark.range(30).select(F.col("id").alias("series_id"), (F.col("id") % 2).alias("label"))
    first = series.cluster_sample(labelled, 3)
    assert sorted(r.series_id for r in first.collect()) == [0, 1, 2, 3, 4, 5]
    assert {r.label: r.n for r in series.cluster_sizes(labelled).collect()} == {0: 15, 1: 15}


def test_segment_cap(spark):
    index = spark.createDataFrame(
        [("s", "c", "j", -1, 30, i) for i in range(20)],
        "session string, config string, job string, part int, layer int, seg_id long",
    )
    assert [r.seg_id for r in series.segment_cap(index, 5).collect()] == list(range(5))
    assert series.segment_cap(index, 50, cap=7).count() == 7


@pytest.mark.parametrize("steps", [1, 2, 9, 20])
def test_pruned_alignment_finds_the_same_label(steps):
    rng = np.random.default_rng(steps)
    centroids, batch = rng.normal(size=(5, steps, 2)).cumsum(axis=1), rng.normal(size=(40, steps, 2)).cumsum(axis=1)
    centroids[4], batch[0] = centroids[1], centroids[1]  # ties go to the lower label
    table = np.stack([alignment.dtw_table(alignment.local_cost(c, batch))[:, -1, -1] for c in centroids], axis=1)
    label, cost, begun = alignment.nearest("dtw", centroids, batch)
    assert (label == table.argmin(axis=1)).all() and np.allclose(cost, table.min(axis=1))
    assert begun <= table.size
    bounds = np.stack([alignment.dtw_bounds(c, batch) for c in centroids], axis=1)
    assert (bounds <= table).all()
    given_up = alignment.dtw_costs(centroids[0], batch, np.full(len(batch), table[:, 0].min()))
    assert np.isinf(given_up[table[:, 0] > given_up.min()]).any() or steps < 8
    soft = alignment.soft_table(alignment.local_cost(centroids[0], batch), 1.0)[:, -1, -1]
    assert np.allclose(alignment.costs("softdtw", centroids[0], batch), soft)


def test_far_centroids_are_not_aligned(waves):
    model = clustering.fit(waves, "dtw", 3)
    assert model.skipped > 0.3
    assert clustering.fit(waves, "euclidean", 3).skipped == 0


def test_descent_never_rises_and_ends_no_higher_than_fixed_steps(waves):
    first = np.array([[r.series for r in waves.orderBy("series_id").limit(3).collect()]], float)
    plain = clustering.fit_from(waves, "softdtw", first, 8)
    model = clustering.descend(waves, "softdtw", first[0], 8)
    assert all(b <= a for a, b in zip(model.history, model.history[1:]))
    assert model.inertia <= plain.inertia + 1e-9
    assert clustering.fit(waves, "softdtw", 3, 4, 1, line_search=True).inertia <= clustering.fit(waves, "softdtw", 3, 4, 1).inertia + 1e-9
    with pytest.raises(ValueError):
        clustering.descend(waves, "softdtw", first[0], 2, (0.5,))


def test_gradient_of_the_cost(waves):
    """The direction of a step against differences of the summed cost, with the series' labels held."""
    first = np.array([r.series for r in waves.orderBy("series_id").limit(1).collect()], float)
    data = np.array([r.series for r in waves.collect()], float)
    found = clustering._measure("softdtw", waves, first[None])[0]
    gradient = 2 * (found.mass[0][:, None] * first[0] - found.sums[0])
    for step, sensor in ((0, 0), (5, 1), (11, 0)):
        up, down = first[0].copy(), first[0].copy()
        up[step, sensor] += 1e-5
        down[step, sensor] -= 1e-5
        slope = (alignment.costs("softdtw", up, data).sum() - alignment.costs("softdtw", down, data).sum()) / 2e-5
        assert gradient[step, sensor] == pytest.approx(slope, rel=1e-4)


def test_seeding_with_repeated_series(spark):
    rows = [(f"s{i}", [[float(i % 2), 0.0]]) for i in range(6)]
    same = spark.createDataFrame(rows, "series_id string, series array<array<double>>").repartition(3)
    seeds = clustering._seeds(same, 4, 2, 1)
    assert seeds.shape == (2, 4, 1, 2)
    with pytest.raises(ValueError):
        clustering._seeds(same, 7, 1, 1)


@pytest.mark.parametrize("metric", ["dtw", "euclidean"])
def test_next_centroids_do_not_depend_on_the_order_of_summation(waves, metric):
    """Paths tie on equal centroid steps, so a last digit that follows the partitions would change the fit."""
    rng = np.random.default_rng(3)
    rows = [(f"s{i:03d}", (rng.normal(size=(12, 2)) * 3).tolist()) for i in range(400)]
    data = waves.sparkSession.createDataFrame(rows, "series_id string, series array<array<double>>")
    first = np.array([rows[i][1] for i in (0, 7)], float)
    moved = [clustering.move(data.repartition(n, F.xxhash64("series_id", F.lit(n))), metric, first) for n in (1, 3, 8)]
    assert (moved[0] == moved[1]).all() and (moved[0] == moved[2]).all()


@pytest.mark.parametrize("scale", [1.0, 6.0, 60.0])
def test_soft_kernels_beyond_the_range_of_doubles(scale):
    rng = np.random.default_rng(5)
    centroid, batch = rng.normal(size=(20, 2)), rng.normal(size=(30, 20, 2)) * scale
    batch[:15] /= scale
    cost = alignment.local_cost(centroid, batch)
    assert np.allclose(alignment.costs("softdtw", centroid, batch), alignment.soft_table(cost, 1.0)[:, -1, -1], rtol=1e-12)
    w = alignment.weights("softdtw", centroid, batch)
    coarse, fine, mass = alignment.pull("softdtw", centroid, alignment.turn(batch))
    assert np.allclose(coarse + fine, np.einsum("bij,bjs->is", w, batch)) and np.allclose(mass, w.sum(axis=(0, 2)))


def test_working_memory_does_not_grow_with_the_batch():
    tracemalloc = pytest.importorskip("tracemalloc")
    rng = np.random.default_rng(6)
    centroids, batch = rng.normal(size=(4, 25, 2)), rng.normal(size=(10_000, 25, 2))
    for metric in ("dtw", "softdtw"):
        tracemalloc.start()
        label, _, _ = alignment.nearest(metric, centroids, batch)
        alignment.pull(metric, centroids[0], alignment.turn(batch[label == label[0]]))
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
        tracemalloc.stop()


def test_distances_of_close_and_far_rows():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 16)) + 1000.0
    b = np.concatenate([a[:10], a[10:20] + 1e-7, rng.normal(size=(5, 16)), np.full((1, 16), np.inf)])
    gap = a[:, None] - b[None]
    assert np.allclose(scores._distances(a, b), np.sqrt((gap * gap).sum(axis=2)), rtol=1e-9, atol=0)


def test_exact_silhouette_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    at, label = rng.normal(size=(300, 4)), rng.integers(0, 3, 300)
    points = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(at, label))], "id long, vec array<double>, label int")
    gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    mean = np.stack([gap[:, label == c].sum(axis=1) for c in range(3)], axis=1)
    size = np.bincount(label)
    a = mean[np.arange(300), label] / (size[label] - 1)
    mean = mean / size
    mean[np.arange(300), label] = np.inf
    expected = ((mean.min(axis=1) - a) / np.maximum(mean.min(axis=1), a)).mean()
    for tile_rows in (None, 7, 100):
        assert scores.quadratic_silhouette(points, tile_rows).first().silhouette == pytest.approx(expected)
    monkeypatch.setattr(scores, "LEAST_ROWS", 10)
    assert scores.quadratic_silhouette(points).first().silhouette == pytest.approx(expected)


def test_batches_are_worked_on_a_block_at_a_time():
    data = np.random.default_rng(4).random((3000, 50, 2))
    batch = pa.RecordBatch.from_pydict({"series_id": [str(i) for i in range(3000)], "series": data.tolist()})
    parts = list(clustering._slices([batch, batch.slice(0, 0)]))
    assert max(len(p) for p in parts) <= alignment.batch_rows(50) < 3000
    assert (np.concatenate([clustering._dense(p.column("series")) for p in parts]) == data).all()
    assert [i for p in parts for i in p.column("series_id").to_pylist()] == [str(i) for i in range(3000)]


@pytest.mark.parametrize("metric", list(clustering.METHODS))
def test_the_fit_knows_its_number_of_labels(spark, metric):
    draw = np.random.default_rng(8)
    rows = [(f"s{i}", (draw.random((6, 2)) + 5 * (i % 3)).tolist()) for i in range(30)]
    table = clustering.prepare(spark.createDataFrame(rows, "series_id string, series array<array<double>>"))
    model = clustering.fit(table, metric, 3, 3, 2)
    assert model.labels == model.assign(table).select("label").distinct().count() > 1
