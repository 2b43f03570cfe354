import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsight.functions import scalars
from poolsight.operators import sketches, viewer


def test_sampling_starts_at_twice_the_budget(spark):
    for n, kept in ((19_999, 19_999), (20_000, 10_000), (10_000, 10_000)):
        df = spark.range(n).select(F.lit("s").alias("session"), F.col("id").alias("idx"))
        assert viewer.systematic_sample(df, block_rows=777).count() == kept


def test_iqr_bounds(spark):
    layers = [30] * 4 + [60] * 4 + [90] * 3 + [3000]
    df = spark.createDataFrame([("s", v) for v in layers], "session string, layer int")
    q = viewer.quantiles(df, ["session"], "layer", {"q1": 0.25, "q3": 0.75}).first()
    assert (q.q1, q.q3) == (30, 90)
    assert sorted(r.layer for r in viewer.iqr_filter(df).collect()) == layers[:-1]
    with pytest.raises(ValueError):
        viewer.quantiles(df, ["session"], "layer", {"q": 0.5}, "other")


def test_linear_quantiles(spark):
    values = np.random.default_rng(0).integers(0, 30, 101)
    df = spark.createDataFrame([("s", int(v)) for v in values], "session string, v int")
    out = viewer.quantiles(df, ["session"], "v", {"a": 0.1, "b": 0.37, "c": 1.0}, "linear").first()
    assert [out.a, out.b, out.c] == pytest.approx(list(np.quantile(values, [0.1, 0.37, 1.0])))


def test_grid_without_width(spark):
    df = spark.createDataFrame([("s", 3.0, float(y)) for y in (1, 2, 3)], "session string, x double, y double")
    assert sorted((r.bx, r.by) for r in viewer.density_grid(df, bins=4).collect()) == [(3, 0), (3, 2), (3, 3)]


def test_grid_and_clip_match_dense_arrays(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 8, 400) / 8, rng.integers(0, 8, 400) / 8
    x[:2], y[:2] = (0, 1), (0, 1)
    rows = [("s", float(a), float(b)) for a, b in zip(x, y)] + [("s", float("nan"), 1.0), ("s", None, 1.0)]
    df = spark.createDataFrame(rows, "session string, x double, y double")
    for bins in (4, 8, 20):
        grid = viewer.density_grid(df, bins=bins)
        dense = np.zeros((bins, bins))
        for r in grid.collect():
            dense[r.bx, r.by] = r.n
        assert (dense == np.histogram2d(x, y, bins=bins)[0]).all()
        for q in (0.5, 0.9, 0.98):
            assert viewer.density_clip(grid, bins=bins, q=q).first().clip == pytest.approx(np.percentile(dense, 100 * q))


def test_counts_nulls_once(spark):
    df = spark.createDataFrame([("s", 1), ("s", 1), ("s", None), ("s", None), ("s", 2)], "session string, v int")
    df = df.withColumns({"config": F.lit("c"), "job": F.lit("j"), "subfolder": F.lit(None).cast("int"), "layer": F.lit(1)})
    assert viewer.n_unique_all(df, ["v"]).first().n_v == 3


def test_scalars(spark):
    sizes = [999, 1000, 1_500_000, 2_000_000_000, 3_500_000_000_000]
    df = spark.createDataFrame([(s,) for s in sizes], "n long")
    assert [r[0] for r in df.select(scalars.format_rows(F.col("n"))).collect()] == ["999", "1K", "1M", "2G", "3T"]
    roles = [
        (500, "1-2", "defect"), (500, "1mm", "scale"), (500, "bottm_right", "anchor"), (150, "x1mm", "unhandled"),
        (150, "1mm", "scale"), (150, "middle", "anchor"), (150, "a-1mm", "defect"), (20, "1mm.roi", "scale"), (20, "top_1", "line"),
    ]
    marks = spark.createDataFrame(roles, "m int, name string, want string")
    for r in marks.withColumn("role", scalars.roi_role(F.col("name"), F.col("m"))).collect():
        assert r.role == r.want
    names = spark.createDataFrame([("bottm_right.roi",), ("bottom_left",)], "n string")
    assert [r[0] for r in names.select(scalars.mark_name(F.col("n"))).collect()] == ["bottom_right", "bottom_left"]


def test_sample_of_layers_that_restart(spark):
    rows = [("s", "c", "j", None, layer, i, 0.0) for layer in range(4) for i in range(100)]
    cloud = spark.createDataFrame(rows, "session string, config string, job string, subfolder int, layer int, idx long, x double")
    want = [(n // 100, n % 100, n) for n in range(0, 400, 4)]
    for parts in (1, 3, 7):
        sample = viewer.systematic_sample(cloud.repartition(parts), 100, block_rows=16)
        assert sorted((r.layer, r.idx, r.row_nr) for r in sample.collect()) == want


def test_infinite_coordinates_take_no_part(spark):
    rows = [("s", float(i), float(i)) for i in range(4)] + [("s", float("inf"), 0.0), ("s", 1.0, float("nan"))]
    cloud = spark.createDataFrame(rows, "session string, x double, y double")
    assert sorted((r.bx, r.by, r.n) for r in viewer.density_grid(cloud, bins=4).collect()) == [(0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1)]


def test_sketches_merge_to_the_stated_bounds(spark):
    rng = np.random.default_rng(6)
    rows = [("s", "c", "j", None, 30 * (1 + i % 5), float(v), None if i % 3 else "x") for i, v in enumerate(rng.normal(size=6000))]
    rows += [("t", "c", "j", None, 30, float("nan"), None), ("t", "c", "j", None, 30, None, None)]
    df = spark.createDataFrame(rows, "session string, config string, job string, subfolder int, layer int, v double, w string")
    stored = sketches.layer_sketches(df, ["v", "w", "layer"], ["v"])
    assert stored.count() == 6
    counts = {r.session: r for r in sketches.n_unique_approx(stored, ["v", "w", "layer"]).collect()}
    assert counts["s"].n_v == pytest.approx(6000, rel=sketches.DISTINCT_ERROR)
    assert (counts["s"].n_w, counts["s"].n_layer) == (2, 5)
    assert (counts["t"].n_v, counts["t"].n_w) == (2, 1)
    found = {r.session: r for r in sketches.quantiles_approx(stored, "v", {"q1": 0.25, "m": 0.5}).collect()}
    values = np.array([r[5] for r in rows[:6000]])
    assert abs((values <= found["s"].q1).mean() - 0.25) <= sketches.RANK_ERROR
    assert abs((values <= found["s"].m).mean() - 0.5) <= sketches.RANK_ERROR
    assert found["t"].q1 is None
    kept = sketches.iqr_filter_approx(df.filter("session = 's'"), stored, "v", reach=0.2).count()
    exact = viewer.iqr_filter(df.filter("session = 's'"), "v", reach=0.2).count()
    assert abs(kept - exact) <= 0.06 * 6000
    assert sketches.n_unique_approx(sketches.layer_sketches(df.limit(0), ["v"]), ["v"]).count() == 0
