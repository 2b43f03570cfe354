"""Reading session files and feature tables, and writing results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from poolsight.functions.scalars import session_label
from poolsight.schema import MEASURES, POINT_CLOUD, STATES
from poolsight.session import cut
from poolsight.sources.pcd import open_file

LEGACY = T.StructType([f for f in POINT_CLOUD.fields if f.name != "idx"])


def scan_sessions(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Parquet session files in the fixed schema; `idx` is the row's place in its file.

    Row order in these files is time order and a layer is one stretch of a file, so `idx` is
    consecutive inside each layer. With `tolerant`, unreadable files are skipped; see
    `session_catalog` for which ones. Columns not used later are never read.
    """
    reader = spark.read.schema(LEGACY).option("pathGlobFilter", "*.parquet")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true")
    return reader.parquet(path).select("*", F.col("_metadata.row_index").alias("idx"))


def session_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Per session: folder, filename, rows, size_mb, label, and an error where files cannot be read.

    A session is one file, or all files of a `session=` folder as `pcd.ingest` writes them (its
    rejects are not counted); it is then named by the value of that folder. Valid files without rows
    count 0 and give no error. Only the footers of files from which no row came are opened again.
    """
    inside = F.regexp_extract("path", "^(.*?/session=[^/]+)/", 1)
    unit = F.when(inside != "", inside).otherwise(F.col("path"))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(_plain(F.col("path")).alias("path"), F.col("path").alias("_open"), "length")
        .filter(~F.col("path").contains("/_"))
    )
    point = F.coalesce(*[F.col(c) for c in MEASURES]).isNotNull()
    counts = (
        spark.read.schema(LEGACY)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .parquet(path)
        .groupBy(_plain(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))).alias("path"))
        .agg(F.count_if(point).alias("n"))
    )
    found = cut(files.join(counts, "path", "left"))
    checked = found.filter("n is null").select("path", "_open").mapInPandas(_footers, "path string, problem string")
    grouped = (
        found.drop("_open").join(checked, "path", "left")
        .groupBy(unit.alias("unit"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            (F.sum("length") / 1048576).alias("size_mb"),
            F.count("problem").alias("broken"),
            F.min("problem").alias("problem"),
        )
    )
    name = F.regexp_replace(F.element_at(F.split("unit", "/"), -1), "^session=", "")
    return grouped.select(
        F.regexp_replace("unit", "/[^/]*$", "").alias("folder"),
        name.alias("filename"),
        "rows",
        "size_mb",
        session_label(name, F.col("rows")).alias("label"),
        F.when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" unreadable: "), F.col("problem"))).alias("error"),
    )


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Why a file's footer cannot be read, null if it can."""
    for frame in frames:
        problems = []
        for path in frame["_open"]:
            try:
                with open_file(path) as f:
                    pq.ParquetFile(f)
                problems.append(None)
            except (OSError, ValueError) as error:  # Arrow's own errors derive from these
                problems.append(f"{type(error).__name__}: {str(error).splitlines()[0][:200]}")
        yield pd.DataFrame({"path": frame["path"], "problem": pd.Series(problems, dtype=object)})


def _plain(path: Column) -> Column:
    """One spelling of a path, whichever source names it."""
    return F.regexp_replace(path, "^file:/+", "/")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index."""
    df.write.mode(mode).option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def warehouse_rows(cloud: DataFrame) -> DataFrame:
    """The warehouse columns with their types: floats, text states, integer layer, and the part number last."""
    text = [*STATES, "session", "config", "job"]
    return cloud.select(
        *[F.col(c).cast("double").alias(c) for c in MEASURES],
        *[F.col(c).cast("string").alias(c) for c in STATES],
        F.col("layer").cast("long").alias("layer"),
        *[F.col(c).cast("string").alias(c) for c in text[len(STATES) :]],
        F.col("subfolder").cast("int").alias("subfolder"),
    )


def warehouse_append(cloud: DataFrame, table: str) -> None:
    """Append to a table of the session catalog, created on first use."""
    rows = warehouse_rows(cloud)
    if cloud.sparkSession.catalog.tableExists(table):
        rows.write.insertInto(table)
    else:
        rows.write.saveAsTable(table)


def warehouse_append_jdbc(cloud: DataFrame, url: str, table: str, batch_rows: int = 10_000, **options: str) -> None:
    """Append over JDBC, one connection per partition."""
    writer = warehouse_rows(cloud).write.format("jdbc").option("url", url).option("dbtable", table)
    writer.option("batchsize", batch_rows).options(**options).mode("append").save()
