"""Session settings, and the shared folder used to cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with.

    Master and shuffle partitions are left to the caller's `spark-submit` unless given.
    """
    builder = SparkSession.builder.appName("poolsight")
    if master is not None:
        builder = builder.master(master)
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (like `--py-files`)."""
    context = spark.sparkContext
    if getattr(context, "_poolsight_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="poolsight-")) / package.name
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    context._poolsight_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    A local session without that setting uses a folder beside its tables; a cluster must set it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the folder of this application."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/poolsight-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete everything this application has cut so far; its DataFrames cannot be read afterwards.

    The application owns these tables: call this between jobs, or at the end.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once below the shared folder and go on from the files.

    Lost executors then cost a re-read, not the whole lineage. As Parquet the data keeps column
    pruning, and its known size lets Spark choose joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
