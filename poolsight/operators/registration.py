"""Placing defect marks of polished sections in part coordinates, many samples at once.

Line marks come as two vertices per line, contours as vertices, boxes as their sides. The
20x section gives the tilt of the cut, the 500x anchors its rotation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from poolsight.functions.scalars import let, mark_name, roi_role
from poolsight.operators import ordered
from poolsight.operators.joins import join_summary

SIDES = ("top", "bottom", "left", "right")
CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")

#: Fixed values of the part: base width b, height h, and the side angle used for z.
BASE = 5.0
HEIGHT = 10.0
Z_ANGLE = math.radians(60)

#: Newton steps on a monotone equation; doubles are exact well before the last one.
NEWTON_STEPS = 12

ROI = ["sample", "magnification", "roi_name"]


def line_length(vertices: DataFrame) -> DataFrame:
    """Length in pixels of each line mark, from its first two vertices; null if one is missing or repeated."""
    at = lambda v, axis: _only(F.col("vertex") == v, F.col(axis))
    ends = vertices.filter(F.col("vertex") < 2).groupBy(*ROI).agg(
        at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(1, "x").alias("x1"), at(1, "y").alias("y1")
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return ends.select(*ROI, F.sqrt(dx * dx + dy * dy).alias("length"))


def _only(where: Column, value: Column) -> Column:
    """The value of the one row of a group that fits, null if there is none or there are several."""
    return F.when(F.count(F.when(where, 1)) == 1, F.max(F.when(where, value)))


def mm_scale(lengths: DataFrame) -> DataFrame:
    """Millimetres per pixel: one over the length of the 1 mm mark; null with several marks."""
    scale = lengths.filter(roi_role(F.col("roi_name"), F.col("magnification")) == "scale")
    length = _only(F.lit(True), F.col("length"))
    return scale.groupBy("sample", "magnification").agg(F.when(length > 0, 1 / F.when(length > 0, length)).alias("mm_scale"))


def edge_lengths(lengths: DataFrame, scales: DataFrame) -> DataFrame:
    """Every line mark in millimetres, null without a scale."""
    return lengths.join(scales, ["sample", "magnification"], "left").select(
        *ROI, (F.col("length") * F.col("mm_scale")).alias("length_mm")
    )


def side_edges(edges: DataFrame) -> DataFrame:
    """Both edge lengths of each side, one row per (sample, side).

    A name that occurs twice, or not at all, gives null lengths and the reason in `error`.
    """
    name = mark_name(F.col("roi_name"))
    parts = edges.filter(F.col("magnification") == 20).select(
        "sample",
        F.regexp_extract(name, "^(top|bottom|left|right)_[12]$", 1).alias("side"),
        F.regexp_extract(name, "_([12])$", 1).alias("edge"),
        "length_mm",
    )
    pick = lambda e: F.max(F.when(F.col("edge") == e, F.col("length_mm")))
    count = lambda e: F.count(F.when(F.col("edge") == e, 1))
    error = (
        F.when((count("1") > 1) | (count("2") > 1), "duplicate mark")
        .when((count("1") == 0) | (count("2") == 0), "missing mark")
        .when(pick("1").isNull() | pick("2").isNull(), "no length")
    )
    return (
        parts.filter("side != ''")
        .groupBy("sample", "side")
        .agg(pick("1").alias("m1"), pick("2").alias("m2"), error.alias("error"))
        .withColumns({m: F.when(F.col("error").isNull(), F.col(m)) for m in ("m1", "m2")})
    )


def tilt(m1: Column, m2: Column, b: float = BASE, h: float = HEIGHT) -> Column:
    """Tilt of one side: the root of tan(a) (b + s cos a) = d tan(theta) cos a.

    With d = |m1 - m2|, s = m1 + m2 and u = tan a this is u (b sqrt(1 + u^2) + s) = d tan(theta),
    whose left side grows and is convex for u >= 0. Newton from the upper bound
    d tan(theta) / (b + s) therefore falls monotonically onto the one root.
    """
    d_tan = F.abs(m1 - m2) * math.tan(math.atan((h / 2) / (b / 2)))
    s = m1 + m2
    u = d_tan / (b + s)
    for _ in range(NEWTON_STEPS):
        u = let(u, lambda x: _newton(x, s, d_tan, b))
    return F.atan(u)


def _newton(u: Column, s: Column, target: Column, b: float) -> Column:
    root = F.sqrt(1 + u * u)
    return u - (u * (b * root + s) - target) / (b * root + s + b * u * u / root)


def alpha(sides: DataFrame, b: float = BASE, h: float = HEIGHT) -> DataFrame:
    """Tilt per (sample, side)."""
    return sides.withColumn("alpha", tilt(F.col("m1"), F.col("m2"), b, h))


def polygon_centroid(vertices: DataFrame, block_rows: int = 1 << 12) -> DataFrame:
    """Centroid of each contour by its first moments; null where the area is zero.

    Vertex n meets vertex n + 1 in bounded blocks of a contour; the closing edge comes from
    the first and the last vertex of the aggregate.
    """
    corner = F.struct("x", "y")
    rows = vertices.withColumn("at", corner)
    chained = ordered.with_neighbours(rows, ROI, "vertex", "at", block_rows)
    cross = _cross(F.col("at"), F.col("next_at"))
    sums = chained.groupBy(*ROI).agg(
        *[F.coalesce(F.sum(part), F.lit(0.0)).alias(name) for name, part in zip("apq", cross)],
        F.min_by("at", "vertex").alias("first"),
        F.max_by("at", "vertex").alias("last"),
    )
    closing = _cross(F.col("last"), F.col("first"))
    area, px, py = (F.col(name) + part for name, part in zip("apq", closing))
    whole = sums.select(*ROI, area.alias("area2"), px.alias("px"), py.alias("py"))
    safe = F.when(F.col("area2") != 0, 3 * F.col("area2"))
    return whole.select(*ROI, (F.col("px") / safe).alias("cx"), (F.col("py") / safe).alias("cy"))


def _cross(p: Column, q: Column) -> tuple[Column, Column, Column]:
    cross = p["x"] * q["y"] - q["x"] * p["y"]
    return cross, (p["x"] + q["x"]) * cross, (p["y"] + q["y"]) * cross


def box_centroid(boxes: DataFrame) -> DataFrame:
    return boxes.select(
        *ROI,
        ((F.col("left") + F.col("right")) / 2).alias("cx"),
        ((F.col("top") + F.col("bottom")) / 2).alias("cy"),
    )


def center(anchors: DataFrame) -> DataFrame:
    """Mean of the five anchors per sample and magnification; null if one is missing or repeated."""
    name = mark_name(F.col("roi_name"))
    wanted = anchors.filter(name.isin(*CORNERS, "middle"))
    whole = (F.count("*") == 5) & (F.count_distinct(name) == 5)
    return wanted.groupBy("sample", "magnification").agg(
        F.when(whole, F.avg("x")).alias("center_x"), F.when(whole, F.avg("y")).alias("center_y")
    )


def phi(anchors: DataFrame, mode: str = "reference", magnification: int = 500) -> DataFrame:
    """Angles of the four edges between the corner anchors, and their mean.

    `reference` averages them as measured, where the vertical pair of a pure rotation has the
    opposite sign of the horizontal pair; `consistent` turns the vertical pair round first. An
    anchor that is missing or repeated gives null angles.
    """
    if mode not in ("reference", "consistent"):
        raise ValueError(f"there is no mode '{mode}'; use 'reference' or 'consistent'")
    at = lambda name, axis: _only(mark_name(F.col("roi_name")) == name, F.col(axis))
    placed = (
        anchors.filter(F.col("magnification") == magnification)
        .groupBy("sample")
        .agg(*[at(c, axis).alias(f"{c}_{axis}") for c in CORNERS for axis in ("x", "y")])
    )

    def edge(start: str, end: str, over: str, under: str) -> Column:
        rise = F.col(f"{end}_{over}") - F.col(f"{start}_{over}")
        run = F.col(f"{end}_{under}") - F.col(f"{start}_{under}")
        return F.when(run != 0, F.atan(rise / F.when(run != 0, run)))

    angles = placed.select(
        "sample",
        edge("top_left", "top_right", "y", "x").alias("angle_top"),
        edge("bottom_left", "bottom_right", "y", "x").alias("angle_bottom"),
        edge("top_left", "bottom_left", "x", "y").alias("angle_left"),
        edge("top_right", "bottom_right", "x", "y").alias("angle_right"),
    )
    sign = 1 if mode == "reference" else -1
    mean = (
        F.col("angle_top") + F.col("angle_bottom") + sign * F.col("angle_left") + sign * F.col("angle_right")
    ) / 4
    return angles.withColumn("phi", mean)


def z_center(tilts: DataFrame, b: float = BASE, h: float = HEIGHT, theta: float = Z_ANGLE) -> DataFrame:
    """Height of the section centre per sample, with the two tilts that place a defect."""
    inset = (h - b) / 2
    flank = lambda m: math.tan(theta) * (F.col(m) * F.cos("alpha") - inset)
    side = F.col("side")
    of_side = lambda name, value: F.max(F.when(side == name, value))
    heights = tilts.withColumn("z", (flank("m1") + flank("m2")) / 2)
    total = sum((of_side(s, F.col("z")) for s in SIDES[1:]), of_side(SIDES[0], F.col("z")))
    return heights.groupBy("sample").agg(
        (total / 4).alias("z_center"),
        of_side("top", F.col("alpha")).alias("alpha_top"),
        of_side("left", F.col("alpha")).alias("alpha_left"),
    )


def calibration(scales: DataFrame, centers: DataFrame, angles: DataFrame, heights: DataFrame) -> DataFrame:
    """All constants of a (sample, magnification) in one row, null where marks do not give them."""
    return (
        centers.join(scales, ["sample", "magnification"], "full")
        .join(angles.select("sample", "phi"), "sample", "left")
        .join(heights, "sample", "left")
    )


def to_part_xyz(centroids: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Every defect in part coordinates, with sample, magnification and name.

    Where a constant is missing the coordinates are null and `error` names what is missing.
    """
    px = (F.col("cx") - F.col("center_x")) * F.col("mm_scale")
    py = (F.col("cy") - F.col("center_y")) * F.col("mm_scale")
    defects = centroids.filter(roi_role(F.col("roi_name"), F.col("magnification")) == "defect")
    needs = {
        "centroid": F.col("cx").isNull() | F.col("cy").isNull(),
        "center": F.col("center_x").isNull() | F.col("center_y").isNull(),
        "scale": F.col("mm_scale").isNull(),
        "rotation": F.col("phi").isNull(),
        "tilt": F.col("z_center").isNull() | F.col("alpha_top").isNull() | F.col("alpha_left").isNull(),
    }
    missing = F.concat_ws(", ", *[F.when(lacks, F.lit(name)) for name, lacks in needs.items()])
    turned = join_summary(defects, calibrated, ["sample", "magnification"], ["roi_name"], "left").select(
        *ROI,
        F.when(missing != "", F.concat(F.lit("missing: "), missing)).alias("error"),
        (px * F.cos("phi") + py * F.sin("phi")).alias("x"),
        (py * F.cos("phi") - px * F.sin("phi")).alias("y"),
        "z_center",
        "alpha_top",
        "alpha_left",
    )
    z = F.col("z_center") + F.col("x") * F.tan("alpha_top") + F.col("y") * F.tan("alpha_left")
    placed = {c: F.when(F.col("error").isNull(), v) for c, v in (("x", F.col("x")), ("y", F.col("y")), ("z", z))}
    return turned.select(*ROI, *[v.alias(c) for c, v in placed.items()], "error")


def unhandled_marks(marks: DataFrame, name: str = "roi_name", magnification: str = "magnification") -> DataFrame:
    """Marks that no step of the registration uses, with the reason; all columns stay."""
    known = F.col(magnification).isin(20, 150, 500)
    reason = F.when(F.col(name).isNull(), "no name").when(known, "no known name at this magnification").otherwise("unknown magnification")
    role = roi_role(F.col(name), F.col(magnification))
    return marks.filter(F.coalesce(role, F.lit("unhandled")) == "unhandled").withColumn("error", F.coalesce(reason, F.lit("unknown magnification")))
