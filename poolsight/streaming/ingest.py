"""Incremental ingest: the batch transformation on a stream of new layer files, into the same dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from poolsight.session import ship
from poolsight.sources import pcd

#: Fixed schema of the binary file source.
FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: One Parquet folder per micro-batch below this one, hidden from readers of the dataset.
MANIFEST = "_manifest"


def file_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES)
    reader = reader.option("pathGlobFilter", "*.pcd").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(root)


def ingest_new(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    max_files: int | None = None,
    range_bytes: int = pcd.RANGE_BYTES,
) -> StreamingQuery:
    """Take in every file not seen before and stop.

    A micro-batch replaces its files in `out` like `pcd.ingest` does, so the two may take turns on one
    folder and a batch that was killed is repeated without doubles. Once its points are stored it
    leaves its list of files in a manifest; files too large to be read whole come in byte ranges.
    """
    ship(spark)

    def take(files: DataFrame, batch: int) -> None:
        pcd.store(pcd.layout(pcd.decode(files.select("path", "length", "content"), range_bytes)), out)
        listed = pcd.parse_log_path(files.select("path", "length")).select("path", "length", "session")
        listed.withColumn("stored", F.current_timestamp()).write.mode("overwrite").parquet(manifest_path(out, checkpoint, batch))

    return (
        file_stream(spark, root, max_files)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def manifest_path(out: str, checkpoint: str, batch: int) -> str:
    stream = checkpoint.rstrip("/").split("/")[-1]
    return f"{out.rstrip('/')}/{MANIFEST}/stream={stream}/batch={batch}"


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """path, length, session, stored, stream, batch of all files that micro-batches have stored."""
    kept = "path string, length long, session string, stored timestamp, stream string, batch long"
    return spark.read.schema(kept).parquet(f"{out.rstrip('/')}/{MANIFEST}")
