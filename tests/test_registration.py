import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsight.operators import registration as reg


def corner_frame(spark, turn=0.0, size=1000.0):
    spots = {"top_left": (-1, -1), "top_right": (1, -1), "bottom_left": (-1, 1), "bottm_right.roi": (1, 1), "middle": (0, 0)}
    c, s = math.cos(turn), math.sin(turn)
    rows = [
        (1, 500, name, 2000 + size * (c * x - s * y), 2000 + size * (s * x + c * y)) for name, (x, y) in spots.items()
    ]
    return spark.createDataFrame(rows, "sample long, magnification int, roi_name string, x double, y double")


def test_tilt(spark):
    df = spark.createDataFrame([(4.0, 3.0), (3.0, 4.0), (3.0, 3.0), (9.0, 0.5)], "m1 double, m2 double")
    a = [r.alpha for r in reg.alpha(df).collect()]
    assert a[:3] == pytest.approx([0.164232168059, 0.164232168059, 0.0], abs=1e-12)
    f = math.tan(a[3]) - 8.5 * 2 * math.cos(a[3]) / (5 + 9.5 * math.cos(a[3]))
    assert f == pytest.approx(0, abs=1e-12)


def test_z_center(spark):
    sides = spark.createDataFrame([(1, s, 4.0, 3.0) for s in reg.SIDES], "sample long, side string, m1 double, m2 double")
    out = reg.z_center(reg.alpha(sides)).first()
    assert out.z_center == pytest.approx(1.650479250542, abs=1e-10)
    assert out.alpha_top == pytest.approx(out.alpha_left)


def test_angles_of_a_rotation(spark):
    anchors = corner_frame(spark, 0.1)
    ref = reg.phi(anchors).first()
    assert (ref.angle_top, ref.angle_left) == (pytest.approx(0.1), pytest.approx(-0.1))
    assert ref.phi == pytest.approx(0, abs=1e-12)
    assert reg.phi(anchors, "consistent").first().phi == pytest.approx(0.1)
    middle = reg.center(anchors).first()
    assert (middle.center_x, middle.center_y) == (pytest.approx(2000), pytest.approx(2000))
    with pytest.raises(ValueError):
        reg.phi(anchors, "other")


def test_polygon_centroid(spark):
    shapes = {"1-r": [(0, 0), (4, 0), (4, 2), (0, 2)], "2-t": [(0, 0), (0, 3), (3, 0)], "3-flat": [(0, 0), (1, 1), (2, 2)]}
    rows = [(1, 500, n, i, float(x), float(y)) for n, p in shapes.items() for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "sample long, magnification int, roi_name string, vertex int, x double, y double")
    for block_rows in (2, 4096):
        out = {r.roi_name: (r.cx, r.cy) for r in reg.polygon_centroid(df, block_rows).collect()}
        assert out == {"1-r": (2.0, 1.0), "2-t": (1.0, 1.0), "3-flat": (None, None)}


def test_lengths_scales_and_mark_errors(spark):
    rows = []
    for name, x, y in [("1mm", 30.0, 40.0), ("top_1", 100.0, 0.0), ("top_2", 0.0, 50.0), ("left_1", 10.0, 0.0), ("left_1.roi", 20.0, 0.0), ("left_2", 5.0, 0.0), ("right_1", 5.0, 0.0)]:
        rows += [(1, 20, name, 0, 0.0, 0.0), (1, 20, name, 1, x, y), (1, 20, name, 2, 999.0, 999.0)]
    df = spark.createDataFrame(rows, "sample long, magnification int, roi_name string, vertex int, x double, y double")
    lengths = reg.line_length(df)
    scales = reg.mm_scale(lengths)
    assert scales.first().mm_scale == pytest.approx(1 / 50)
    sides = {r.side: r for r in reg.side_edges(reg.edge_lengths(lengths, scales)).collect()}
    assert (sides["top"].m1, sides["top"].m2, sides["top"].error) == (2.0, 1.0, None)
    assert sides["left"].error == "duplicate mark" and sides["left"].m1 is None
    assert sides["right"].error == "missing mark"


def test_positions_against_plain_arithmetic(spark):
    centroids = spark.createDataFrame(
        [(1, 500, "a-1", 2100.0, 1900.0), (1, 500, "note", 0.0, 0.0)],
        "sample long, magnification int, roi_name string, cx double, cy double",
    )
    calibrated = spark.createDataFrame(
        [(1, 500, 2000.0, 2000.0, 0.01, 0.2, 3.0, 0.1, 0.05)],
        "sample long, magnification int, center_x double, center_y double, mm_scale double, phi double, z_center double, alpha_top double, alpha_left double",
    )
    out = reg.to_part_xyz(centroids, calibrated).collect()
    assert len(out) == 1
    turn = np.array([[math.cos(0.2), math.sin(0.2)], [-math.sin(0.2), math.cos(0.2)]])
    x, y = turn @ np.array([1.0, -1.0])
    assert (out[0].x, out[0].y) == (pytest.approx(x), pytest.approx(y))
    assert out[0].z == pytest.approx(3 + x * math.tan(0.1) + y * math.tan(0.05))


def test_box_centroid(spark):
    df = spark.createDataFrame(
        [(1, 150, "a-1", 1.0, 2.0, 5.0, 8.0)],
        "sample long, magnification int, roi_name string, left double, top double, right double, bottom double",
    )
    out = reg.box_centroid(df).first()
    assert (out.cx, out.cy) == (3.0, 5.0)


def test_nothing_is_blended_or_lost(spark):
    anchors = corner_frame(spark)
    twice = anchors.unionByName(anchors.filter("roi_name = 'top_left'").withColumn("x", F.col("x") + 9))
    missing = anchors.filter("roi_name <> 'middle'")
    assert reg.center(twice).first().center_x is None and reg.center(missing).first().center_x is None
    assert reg.phi(twice).first().phi is None and reg.phi(missing).first().phi is not None
    defects = spark.createDataFrame([(1, 500, "a-1", 1.0, 1.0), (9, 500, "b-1", 1.0, 1.0)], "sample long, magnification int, roi_name string, cx double, cy double")
    scales = spark.createDataFrame([(1, 500, 0.01)], "sample long, magnification int, mm_scale double")
    heights = spark.createDataFrame([(1, 3.0, 0.1, 0.1)], "sample long, z_center double, alpha_top double, alpha_left double")
    known = reg.calibration(scales, reg.center(twice), reg.phi(twice), heights)
    got = {r.sample: (r.x, r.error) for r in reg.to_part_xyz(defects, known).collect()}
    assert got[1] == (None, "missing: center, rotation") and got[9][0] is None and got[9][1].startswith("missing: center, scale")
