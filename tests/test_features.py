import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsight.operators import features
from poolsight.operators.mapping import map_segments

SIGNAL = [1.0, 2.0, 4.0, 8.0, 7.0, 5.0, 3.0, 2.0, 2.0, 1.0]


@pytest.fixture
def rows(spark):
    def build(*series, other=None):
        data = [
            ("s", "c", "j", -1, 30, seg, len(values), pos, v, (other or values)[pos])
            for seg, values in enumerate(series)
            for pos, v in enumerate(values)
        ]
        return spark.createDataFrame(
            data,
            "session string, config string, job string, part int, layer int, seg_id long, length long, pos long, sensor0 double, sensor1 double",
        )

    return build


def test_golden_signal(rows):
    out = features.feature_table(rows(SIGNAL)).filter("sensor = 'sensor0'").first()
    assert out["mean"] == pytest.approx(3.5)
    assert out["std"] == pytest.approx(2.334524, abs=1e-6)
    assert out["cv"] == pytest.approx(0.667007, abs=1e-6)
    assert out["slope"] == pytest.approx(-0.163636, abs=1e-6)
    assert out["dominant_freq"] == 0
    want = [3.225, 0.1, -2.425, -2.7, -1.925, -0.85, 0.475, 0.75, 0.625]
    assert [out[f"autoco_{k}"] for k in range(1, 10)] == pytest.approx(want)
    assert out["segment_length"] == 10 and not out["bad_signal"]


def test_fixed_b_and_recovery(rows):
    fixed = features.features(rows(SIGNAL), autocov=False, fit_grid=[-0.1]).filter("sensor = 'sensor0'").first()
    assert (fixed.mse, fixed.x_intercept) == (pytest.approx(5.04), pytest.approx(3.6))
    curve = [5 - math.exp(-10 * i / 40) for i in range(20)]
    found = features.features(rows(curve), autocov=False, fit_grid=[-0.1, -20.0, -40.0, -80.0]).first()
    assert found.y_intercept == -40.0
    assert found.x_intercept == pytest.approx(5.0)
    assert found.mse == pytest.approx(0.0, abs=1e-12)


def test_fit_clips_a_and_never_loses_to_the_start(rows):
    out = features.features(rows([-5.0] * 12), autocov=False).first()
    assert out.x_intercept == 0.0
    grid = features.features(rows(SIGNAL), autocov=False).first()
    assert grid.mse <= 5.04 + 1e-9


def test_bad_signals_are_flagged_not_fatal(rows):
    out = features.features(rows([1.0, float("nan"), 2.0] * 4, SIGNAL)).filter("sensor = 'sensor0'").orderBy("seg_id").collect()
    assert [r.bad_signal for r in out] == [True, False]
    assert out[0]["mean"] is None and out[0]["mse"] is None
    short = features.features(rows([1.0, 2.0])).first()
    assert short.bad_signal and short["slope"] is None
    assert features.features(rows([1.0, -1.0] * 6), autocov=False, fit_grid=None).first()["cv"] is None


def test_refined_fit(rows):
    series = [[5 - math.exp(10 * i / b) for i in range(60)] for b in (-0.05, -37.3, -111.0, -999.0)]
    series += [np.random.default_rng(8).normal(size=40).tolist(), [1.0, 2.0], [float("nan")] * 5]
    data = rows(*series)
    grid = features.features(data, autocov=False)
    refined = {(r.seg_id, r.sensor): r for r in features.refine_fit(grid, data, passes=5).collect()}
    assert len(refined) == 14
    for r in grid.collect():
        now = refined[(r.seg_id, r.sensor)]
        if r.seg_id > 4:
            assert now.bad_signal and now.mse is None and now.y_intercept is None
            continue
        assert now.mse <= r.mse + 1e-6
        assert (now["mean"], now.segment_length) == (r["mean"], r.segment_length)
    for seg, b in ((1, -37.3), (2, -111.0), (3, -999.0)):
        assert refined[(seg, "sensor0")].y_intercept == pytest.approx(b, rel=0.02)
        assert refined[(seg, "sensor0")].mse < 1e-5


def test_lags_cross_window_borders(spark, rows):
    rng = np.random.default_rng(3)
    v = rng.normal(size=50)
    lagged = features.lagged_signals(rows(v.tolist()), lags=9, window_rows=12).filter("sensor = 'sensor1'").orderBy("pos").collect()
    assert len(lagged) == 50
    for r in lagged:
        for k in range(1, 10):
            assert r[f"lead_{k}"] == (pytest.approx(v[r.pos + k]) if r.pos + k < 50 else None)


def naive_peak(v, skip):
    magnitude = np.round(np.abs(np.fft.rfft(v)), 6)
    return skip + int(np.argmax(magnitude[skip:]))


@pytest.mark.parametrize("skip", [0, 1])
def test_spectrum_short_and_distributed(rows, skip):
    rng = np.random.default_rng(5)
    series = [rng.normal(size=n).tolist() for n in (11, 12, 37, 64, 101)]
    series.append([math.sin(2 * math.pi * 3 * i / 40) for i in range(40)])
    df = rows(*series)
    want = [naive_peak(np.array(v), skip) for v in series]
    for fft_rows in (1 << 20, 20):
        out = features.dominant_freq(df, ["sensor0"], skip_dc=bool(skip), fft_rows=fft_rows).orderBy("seg_id").collect()
        assert [r.dominant_freq for r in out] == want


def test_histogram_and_summary(spark):
    values = [0.0, 0.4, 0.5, 0.6, 1.0, 9.0, 8.5, 8.4]
    table = spark.createDataFrame([(v, -v) for v in values], "x_intercept double, y_intercept double")
    bins = {r.bin: r.n for r in features.histogram(table, "x_intercept").collect()}
    # centres 0..9, right-closed at .5
    assert bins == {0: 3, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 2, 9: 1}
    sd = features.mean_sd(table).first()
    assert sd.x_mean == pytest.approx(np.mean(values)) and sd.x_sd == pytest.approx(np.std(values, ddof=1))
    logs = [r.log10_y for r in features.negated_log10(table).collect()]
    assert logs[0] is None and logs[4] == pytest.approx(0.0)
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert sum(r.n for r in features.histogram(same, "x").collect()) == 2


def test_map_segments_in_parts(rows):
    def sizes(frame):
        assert frame["pos"].is_monotonic_increasing
        return frame[["seg_id", "sensor"]].iloc[:1].assign(n=len(frame), total=frame["v"].sum())

    signal = features.signals(rows(SIGNAL))
    whole = [F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum("total").alias("total")]
    results = []
    for call_rows, parts in ((4, 3), (100, 1)):
        out = map_segments(signal, sizes, "seg_id long, sensor string, n long, total double", call_rows, whole).collect()
        assert sorted((r.sensor, r.n, r.parts) for r in out) == [("sensor0", 10, parts), ("sensor1", 10, parts)]
        results.append(sorted((r.sensor, r.total) for r in out))
    assert results[0] == results[1]


def test_map_segments_streams_parts(rows, spark):
    """Parts are called one by one in a stream of sorted rows, whole also where a batch of rows ends within one."""
    signal = features.signals(rows(*[SIGNAL] * 40))

    def sizes(frame):
        assert frame["pos"].is_monotonic_increasing and frame["seg_id"].nunique() == 1 and list(frame.index) == list(range(len(frame)))
        return {"seg_id": frame["seg_id"].iat[0], "sensor": frame["sensor"].iat[0], "n": len(frame), "total": frame["v"].sum()}

    whole = [F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum("total").alias("total")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for call_rows, parts in ((4, 3), (7, 2), (100, 1)):
            mapped = map_segments(signal, sizes, "seg_id long, sensor string, n long, total double", call_rows, whole)
            assert "FlatMapGroups" not in mapped._jdf.queryExecution().toString()
            out = mapped.collect()
            assert len(out) == 80 and {(r.n, r.parts, r.total) for r in out} == {(10, parts, sum(SIGNAL))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
