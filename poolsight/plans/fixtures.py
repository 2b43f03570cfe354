"""Point clouds and marks derived from the given tables, in Spark and as the same SQL.

The tables hold no sensor data, so every column below is plain arithmetic on their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LAYER_ROWS = 500
LAYERS_PER_SESSION = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a point cloud: 500 rows per layer, five layers per session."""
    nr = F.expr("event_id div 500")
    on = (F.col("event_id") + 7 * nr) % 37 < 22
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") * 10.0).alias("t"),
        F.col("user_id").cast("double").alias("x"),
        value.alias("y"),
        (nr * F.lit(0.03)).alias("z"),
        value.alias("sensor0"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("sensor1"),
        (value / 2).alias("sensor2"),
        F.lit(0.0).alias("sensor3"),
        on.cast("int").alias("state0"),
        (F.col("event_id") % 3).cast("int").alias("state1"),
        F.expr("cast((event_id div 4 + event_id div 7) % 3 as int)").alias("state_m"),
        (30 * nr).cast("int").alias("layer"),
        F.concat(F.lit("s"), F.expr("event_id div 2500")).alias("session"),
        F.lit("1_c").alias("config"),
        F.lit("1_j").alias("job"),
        F.lit(None).cast("int").alias("subfolder"),
        F.col("event_id").alias("idx"),
    )


PC_SQL = """
pc as (
  select 10.0e0 * event_id as t, cast(user_id as double) as x, value as y,
         (event_id // 500) * 0.03e0 as z, value as sensor0,
         cast(regexp_extract(props, '([0-9]+)', 1) as double) as sensor1,
         value / 2 as sensor2, 0.0e0 as sensor3,
         case when (event_id + 7 * (event_id // 500)) % 37 < 22 then 1 else 0 end as state0,
         cast(event_id % 3 as integer) as state1,
         cast((event_id // 4 + event_id // 7) % 3 as integer) as state_m,
         cast(30 * (event_id // 500) as integer) as layer,
         's' || (event_id // 2500) as session, '1_c' as config, '1_j' as job,
         cast(null as integer) as subfolder, event_id as idx
  from events
)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line marks of the 20x section per sample: name, vertex 0 and 1 (pixels)."""
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    lines = [(20, "1mm", F.lit(200.0)), (150, "1mm", F.lit(1500.0)), (500, "1mm", F.lit(5000.0))]
    for side, name in enumerate(("top", "bottom", "left", "right")):
        m1 = (26 + (key + side) % 7) / 10
        m2 = (26 + (2 * key + side) % 5) / 10
        lines += [(20, f"{name}_1", m1 * 200.0), (20, f"{name}_2", m2 * 200.0)]
    drawn = F.array(
        *[F.struct(F.lit(m).alias("magnification"), F.lit(n).alias("roi_name"), x.alias("px")) for m, n, x in lines]
    )
    ends = supplier.select(key.alias("sample"), F.inline(drawn))
    vertices = F.array(
        F.struct(F.lit(0).alias("vertex"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        F.struct(F.lit(1).alias("vertex"), F.col("px").alias("x"), F.lit(0.0).alias("y")),
    )
    return ends.select("sample", "magnification", "roi_name", F.inline(vertices))


MARKS_SQL = """
sides(side, side_name) as (values (0, 'top'), (1, 'bottom'), (2, 'left'), (3, 'right')),
marks as (
  select s_suppkey as sample, 20 as magnification, side_name || '_1' as roi_name,
         (26 + (s_suppkey + side) % 7) / 10 * 200.0e0 as px from supplier, sides
  union all
  select s_suppkey, 20, side_name || '_2', (26 + (2 * s_suppkey + side) % 5) / 10 * 200.0e0 from supplier, sides
  union all
  select s_suppkey, m, '1mm', p from supplier, (values (20, 200.0e0), (150, 1500.0e0), (500, 5000.0e0)) v(m, p)
)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the five anchor marks per sample and magnification."""
    key = F.col("s_suppkey")
    spots = [
        ("top_left", -1000.0, -1000.0),
        ("top_right", 1000.0, -1000.0),
        ("bottom_left", -1000.0, 1000.0),
        ("bottom_right", 1000.0, 1000.0),
        ("middle", 0.0, 0.0),
    ]
    placed = F.array(
        *[F.struct(F.lit(n).alias("roi_name"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in spots]
    )
    lifted = F.when(F.col("roi_name") == "top_right", 10 * (key % 5)).otherwise(0)
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", F.explode(F.array(F.lit(150), F.lit(500))).alias("magnification"), F.inline(placed))
        .select(
            key.alias("sample"),
            "magnification",
            "roi_name",
            (2000.0 + F.col("dx") + key % 11).alias("x"),
            (2000.0 + F.col("dy") + lifted).alias("y"),
        )
    )


ANCHORS_SQL = """
anchors as (
  select s_suppkey as sample, m as magnification, roi_name,
         2000.0e0 + dx + s_suppkey % 11 as x,
         2000.0e0 + dy + case when roi_name = 'top_right' then 10 * (s_suppkey % 5) else 0 end as y
  from supplier, (values (150), (500)) g(m),
       (values ('top_left', -1000, -1000), ('top_right', 1000, -1000), ('bottom_left', -1000, 1000),
               ('bottom_right', 1000, 1000), ('middle', 0, 0)) v(roi_name, dx, dy)
)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-vertex defect contours, one per order, ten samples; roi_name '<orderkey>-d'."""
    key = F.col("o_orderkey")
    corner = F.col("vertex")
    reach = 3 + (key + 3 * corner) % 5
    angle = corner * (F.pi() / 4)
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("vertex"))
        .select(
            (F.col("o_custkey") % 10).alias("sample"),
            F.lit(500).alias("magnification"),
            F.concat(key.cast("string"), F.lit("-d")).alias("roi_name"),
            "vertex",
            ((1000 + (37 * key) % 2000) + reach * F.cos(angle)).alias("x"),
            ((1000 + (91 * key) % 2000) + reach * F.sin(angle)).alias("y"),
        )
    )


POLYGONS_SQL = """
polygons as (
  select o_custkey % 10 as sample, 500 as magnification, o_orderkey || '-d' as roi_name, vertex,
         (1000 + (37 * o_orderkey) % 2000) + (3 + (o_orderkey + 3 * vertex) % 5) * cos(vertex * (pi() / 4)) as x,
         (1000 + (91 * o_orderkey) % 2000) + (3 + (o_orderkey + 3 * vertex) % 5) * sin(vertex * (pi() / 4)) as y
  from orders, range(8) r(vertex)
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of the same defects at 150x."""
    key = F.col("o_orderkey")
    half = (2 + key % 5).cast("double")
    cx, cy = 1000 + (37 * key) % 2000, 1000 + (91 * key) % 2000
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("sample"),
        F.lit(150).alias("magnification"),
        F.concat(key.cast("string"), F.lit("-d")).alias("roi_name"),
        (cx - half).alias("left"),
        (cy - half).alias("top"),
        (cx + half).alias("right"),
        (cy + half).alias("bottom"),
    )


BOXES_SQL = """
boxes as (
  select o_custkey % 10 as sample, 150 as magnification, o_orderkey || '-d' as roi_name,
         1000.0e0 + (37 * o_orderkey) % 2000 - (2 + o_orderkey % 5) as "left",
         1000.0e0 + (91 * o_orderkey) % 2000 - (2 + o_orderkey % 5) as "top",
         1000.0e0 + (37 * o_orderkey) % 2000 + (2 + o_orderkey % 5) as "right",
         1000.0e0 + (91 * o_orderkey) % 2000 + (2 + o_orderkey % 5) as "bottom"
  from orders
)"""
