"""The point-cloud schema and the keys that identify one layer file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

MEASURES = ["t", "x", "y", "z", "sensor0", "sensor1", "sensor2", "sensor3"]
STATES = ["state0", "state1"]
SENSORS = ["sensor0", "sensor1"]

#: One schema for every session; `subfolder` is null where the path names no part.
POINT_CLOUD = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in MEASURES]
    + [T.StructField(c, T.IntegerType()) for c in STATES]
    + [
        T.StructField("layer", T.IntegerType()),
        T.StructField("session", T.StringType()),
        T.StructField("config", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("subfolder", T.IntegerType()),
        T.StructField("idx", T.LongType()),
    ]
)

#: Keys of one layer. `part` is `subfolder` with -1 for null, so that plain equality joins
#: keep those rows and reuse the partitioning of earlier windows.
LAYER = ["session", "config", "job", "part", "layer"]

NO_PART = -1


def part_key(column: str = "subfolder") -> Column:
    return F.coalesce(F.col(column), F.lit(NO_PART))


def keyed(df: DataFrame) -> DataFrame:
    """Add the `part` key to a point cloud."""
    return df if "part" in df.columns else df.withColumn("part", part_key())


def with_subfolder(df: DataFrame) -> DataFrame:
    """Turn the `part` key back into the nullable `subfolder`."""
    part = F.col("part")
    return df.withColumn("subfolder", F.when(part != NO_PART, part)).drop("part")


def require(df: DataFrame, *columns: str) -> None:
    """Fail when the plan is built, not when it runs, if a column is missing."""
    for name in columns:
        if name not in df.columns:
            raise KeyError(f"the table lacks column {name}")
