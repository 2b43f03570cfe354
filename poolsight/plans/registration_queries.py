"""Registration of defect marks for all samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.functions import scalars
from poolsight.operators import registration as reg
from poolsight.plans import fixtures
from poolsight.plans.fixtures import ANCHORS_SQL, BOXES_SQL, MARKS_SQL, POLYGONS_SQL
from poolsight.plans.registry import query, r, rounded

ROI_SQL = "sample, magnification, roi_name"

SCALE_SQL = "scales as (select sample, magnification, 1 / px as mm_scale from marks where roi_name = '1mm')"

SIDES_SQL = """
edges as (select m.sample, m.roi_name, px * mm_scale as mm from marks m join scales s using (sample, magnification) where magnification = 20),
side_edges as (
  select sample, split_part(roi_name, '_', 1) as side, max(mm) filter (roi_name like '%_1') as m1, max(mm) filter (roi_name like '%_2') as m2
  from edges where roi_name <> '1mm' group by all
)"""

#: Sixty bisections of tan a - d tan(theta) cos a / (b + s cos a).
ALPHA_SQL = """
halving as (
  select sample, side, m1, m2, 0.0e0 as lo, pi() / 2 as hi, 0 as step from side_edges
  union all
  select sample, side, m1, m2,
    case when tan((lo + hi) / 2) < abs(m1 - m2) * 2 * cos((lo + hi) / 2) / (5 + (m1 + m2) * cos((lo + hi) / 2)) then (lo + hi) / 2 else lo end,
    case when tan((lo + hi) / 2) < abs(m1 - m2) * 2 * cos((lo + hi) / 2) / (5 + (m1 + m2) * cos((lo + hi) / 2)) then hi else (lo + hi) / 2 end,
    step + 1
  from halving where step < 60
),
tilts as (select sample, side, m1, m2, case when m1 = m2 then 0 else (lo + hi) / 2 end as alpha from halving where step = 60)"""

CENTROID_SQL = """
edges2 as (
  select sample, magnification, roi_name, x, y,
    coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2
  from polygons window w as (partition by sample, magnification, roi_name order by vertex)
),
centroids as (
  select sample, magnification, roi_name, sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) as cx,
    sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) as cy
  from edges2 group by all
)"""

ANGLES_SQL = """
corners as (
  select sample, max(x) filter (roi_name = 'top_left') as tlx, max(y) filter (roi_name = 'top_left') as tly,
    max(x) filter (roi_name = 'top_right') as trx, max(y) filter (roi_name = 'top_right') as try,
    max(x) filter (roi_name = 'bottom_left') as blx, max(y) filter (roi_name = 'bottom_left') as bly,
    max(x) filter (roi_name = 'bottom_right') as brx, max(y) filter (roi_name = 'bottom_right') as bry
  from anchors where magnification = 500 group by sample
),
angles as (
  select sample, atan((try - tly) / (trx - tlx)) as angle_top, atan((bry - bly) / (brx - blx)) as angle_bottom,
    atan((blx - tlx) / (bly - tly)) as angle_left, atan((brx - trx) / (bry - try)) as angle_right
  from corners
),
phis as (select *, (angle_top + angle_bottom + angle_left + angle_right) / 4 as phi from angles),
centers as (select sample, magnification, avg(x) as center_x, avg(y) as center_y from anchors group by all)"""

Z_SQL = """
heights as (
  select sample, avg(tan(radians(60)) * ((m1 + m2) / 2 * cos(alpha) - 2.5e0)) as z_center,
    max(alpha) filter (side = 'top') as alpha_top, max(alpha) filter (side = 'left') as alpha_left
  from tilts group by sample
)"""


def position_sql(source: str) -> str:
    return f"""
offsets as (
  select d.sample, d.magnification, d.roi_name, (cx - center_x) * mm_scale as px, (cy - center_y) * mm_scale as py,
    phi, z_center, alpha_top, alpha_left
  from {source} d join centers using (sample, magnification) join scales using (sample, magnification)
  join phis using (sample) join heights using (sample)
),
placed as (
  select {ROI_SQL}, px * cos(phi) + py * sin(phi) as x, -px * sin(phi) + py * cos(phi) as y, z_center, alpha_top, alpha_left from offsets
)
select {ROI_SQL}, {r('x', 'x')}, {r('y', 'y')}, {r('z_center + x * tan(alpha_top) + y * tan(alpha_left)', 'z')} from placed"""


def lengths(spark, sf_dir):
    return reg.line_length(fixtures.marks(spark, sf_dir))


def tilts(spark, sf_dir):
    found = lengths(spark, sf_dir)
    return reg.alpha(reg.side_edges(reg.edge_lengths(found, reg.mm_scale(found))))


def calibrated(spark, sf_dir):
    anchors = fixtures.anchors(spark, sf_dir)
    scales = reg.mm_scale(lengths(spark, sf_dir))
    heights = reg.z_center(tilts(spark, sf_dir))
    return reg.calibration(scales, reg.center(anchors), reg.phi(anchors), heights)


@query("line_length", f"with {MARKS_SQL} select {ROI_SQL}, {r('px', 'length')} from marks")
def line_length(spark, sf_dir):
    return rounded(lengths(spark, sf_dir), ["length"])


@query("mm_scale", f"with {MARKS_SQL}, {SCALE_SQL} select sample, magnification, {r('mm_scale', 'mm_scale', 9)} from scales")
def mm_scale(spark, sf_dir):
    return rounded(reg.mm_scale(lengths(spark, sf_dir)), ["mm_scale"], 9)


@query(
    "edge_lengths",
    f"with {MARKS_SQL}, {SCALE_SQL} select {ROI_SQL}, {r('px * mm_scale', 'length_mm')} from marks join scales using (sample, magnification)",
)
def edge_lengths(spark, sf_dir):
    found = lengths(spark, sf_dir)
    return rounded(reg.edge_lengths(found, reg.mm_scale(found)), ["length_mm"])


@query(
    "alpha",
    f"with recursive {MARKS_SQL}, {SCALE_SQL}, {SIDES_SQL}, {ALPHA_SQL} select sample, side, {r('m1', 'm1')}, {r('m2', 'm2')}, {r('alpha', 'alpha')} from tilts",
)
def alpha(spark, sf_dir):
    return rounded(tilts(spark, sf_dir).drop("error"), ["m1", "m2", "alpha"])


@query("polygon_centroid", f"with {POLYGONS_SQL}, {CENTROID_SQL} select {ROI_SQL}, {r('cx', 'cx')}, {r('cy', 'cy')} from centroids")
def polygon_centroid(spark, sf_dir):
    return rounded(reg.polygon_centroid(fixtures.polygons(spark, sf_dir)), ["cx", "cy"])


@query(
    "box_centroid",
    f"""with {BOXES_SQL} select {ROI_SQL}, ("left" + "right") / 2 as cx, ("top" + "bottom") / 2 as cy from boxes""",
)
def box_centroid(spark, sf_dir):
    return reg.box_centroid(fixtures.boxes(spark, sf_dir))


@query(
    "phi_center",
    f"""with {ANCHORS_SQL}, {ANGLES_SQL} select sample, magnification, {r('center_x', 'center_x')}, {r('center_y', 'center_y')},
  {r('angle_top', 'angle_top')}, {r('angle_bottom', 'angle_bottom')}, {r('angle_left', 'angle_left')}, {r('angle_right', 'angle_right')},
  {r('phi', 'phi')} from centers join phis using (sample)""",
)
def phi_center(spark, sf_dir):
    anchors = fixtures.anchors(spark, sf_dir)
    out = reg.center(anchors).join(reg.phi(anchors), "sample")
    return rounded(out, [c for c in out.columns if c not in ("sample", "magnification")])


@query(
    "z_center",
    f"with recursive {MARKS_SQL}, {SCALE_SQL}, {SIDES_SQL}, {ALPHA_SQL}, {Z_SQL} select sample, {r('z_center', 'z_center')}, "
    f"{r('alpha_top', 'alpha_top')}, {r('alpha_left', 'alpha_left')} from heights",
)
def z_center(spark, sf_dir):
    return rounded(reg.z_center(tilts(spark, sf_dir)), ["z_center", "alpha_top", "alpha_left"])


ALL_SQL = f"{MARKS_SQL}, {SCALE_SQL}, {SIDES_SQL}, {ALPHA_SQL}, {Z_SQL}, {ANCHORS_SQL}, {ANGLES_SQL}"


@query(
    "part_xyz",
    f"with recursive {ALL_SQL}, {POLYGONS_SQL}, {CENTROID_SQL}, {position_sql('centroids')}",
)
def part_xyz(spark, sf_dir):
    centroids = reg.polygon_centroid(fixtures.polygons(spark, sf_dir))
    return rounded(reg.to_part_xyz(centroids, calibrated(spark, sf_dir)).drop("error"), ["x", "y", "z"])


@query(
    "part_xyz_errors",
    f"""with {POLYGONS_SQL} select distinct {ROI_SQL}, case sample % 5 when 1 then 'missing: scale' when 2 then 'missing: center, rotation'
  when 3 then 'missing: center, rotation' when 4 then 'missing: tilt' end as error, sample % 5 = 0 as placed from polygons""",
)
def part_xyz_errors(spark, sf_dir):
    """Samples without a 500x scale mark, with a missing or a repeated anchor, or without a line mark keep their defects."""
    kind = F.col("sample") % 5
    marks, anchors = fixtures.marks(spark, sf_dir), fixtures.anchors(spark, sf_dir)
    no_scale = (kind == 1) & (F.col("magnification") == 500)
    no_edge = (kind == 4) & (F.col("roi_name") == "left_2")
    found = reg.line_length(marks.filter(~no_scale & ~no_edge))
    scales = reg.mm_scale(found)
    anchors = anchors.filter((kind != 2) | (F.col("roi_name") != "top_left"))
    anchors = anchors.unionByName(anchors.filter((kind == 3) & (F.col("roi_name") == "top_right")).withColumn("x", F.col("x") + 5))
    heights = reg.z_center(reg.alpha(reg.side_edges(reg.edge_lengths(found, scales))))
    known = reg.calibration(scales, reg.center(anchors), reg.phi(anchors), heights)
    out = reg.to_part_xyz(reg.polygon_centroid(fixtures.polygons(spark, sf_dir)), known)
    return out.select(*reg.ROI, "error", (F.col("x").isNotNull() & F.col("z").isNotNull()).alias("placed"))


@query(
    "part_xyz_150",
    f"""with recursive {ALL_SQL}, {BOXES_SQL},
middles as (select {ROI_SQL}, ("left" + "right") / 2 as cx, ("top" + "bottom") / 2 as cy from boxes), {position_sql('middles')}""",
)
def part_xyz_150(spark, sf_dir):
    centroids = reg.box_centroid(fixtures.boxes(spark, sf_dir))
    return rounded(reg.to_part_xyz(centroids, calibrated(spark, sf_dir)).drop("error"), ["x", "y", "z"])


NAMES_SQL = """names as (
  select o_orderkey, case o_orderkey % 3 when 0 then 20 when 1 then 150 else 500 end as magnification,
    case o_orderkey % 7 when 0 then '1mm' when 1 then '1mm.roi' when 2 then 'top_left' when 3 then o_orderkey || '-d'
      when 4 then 'left_1' when 5 then 'middle' else 'note' end as roi_name from orders
)"""


@query(
    "roi_role",
    f"""with {NAMES_SQL} select *, case
  when magnification = 20 then case when contains(roi_name, '1mm') then 'scale' else 'line' end
  when magnification = 500 then case when contains(roi_name, '-') then 'defect' when contains(roi_name, '1mm') then 'scale' else 'anchor' end
  when roi_name = '1mm' then 'scale' when contains(roi_name, '-') then 'defect'
  when contains(roi_name, 'top') or contains(roi_name, 'bottom') or contains(roi_name, 'middle') then 'anchor'
  else 'unhandled' end as role from names""",
)
def roi_role(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("role", scalars.roi_role(F.col("roi_name"), F.col("magnification")))


def _names(spark, sf_dir):
    key = F.col("o_orderkey")
    names = F.array(
        F.lit("1mm"), F.lit("1mm.roi"), F.lit("top_left"), F.concat(key.cast("string"), F.lit("-d")),
        F.lit("left_1"), F.lit("middle"), F.lit("note"),
    )
    return fixtures.table(spark, sf_dir, "orders").select(
        key,
        F.element_at(F.array(F.lit(20), F.lit(150), F.lit(500)), (key % 3).cast("int") + 1).alias("magnification"),
        F.element_at(names, (key % 7).cast("int") + 1).alias("roi_name"),
    )


@query(
    "roi_rejects",
    f"""with {NAMES_SQL} select *, 'no known name at this magnification' as error from names
where magnification = 150 and roi_name <> '1mm' and not contains(roi_name, '-')
  and not contains(roi_name, 'top') and not contains(roi_name, 'bottom') and not contains(roi_name, 'middle')""",
)
def roi_rejects(spark, sf_dir):
    return reg.unhandled_marks(_names(spark, sf_dir))
