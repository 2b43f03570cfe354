"""From raw documents to packed training sequences, one operator per stage.

Every stage works on all documents its predecessor kept. Each result is written below the shared
folder and read again, so a lost executor costs a stage's tasks, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolsight.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules
from poolsight.session import scratch_path, ship

#: The classifier is fitted to the labels of each run and the packed rows follow from it; SQL has no such fit.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below 0.5."""
    ship(spark)
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.add_score(docs, "_cp_score").filter("_cp_score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in three documents or more, except in the largest doc_id."""
    ship(spark)
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    ship(spark)
    found = minhash_dedup.near_duplicates(docs, width=5, percent=80)
    gone = found.groupBy(F.col("doc_id").alias("_cp_gone")).agg(F.bool_or("kept").alias("_cp_kept")).filter("not _cp_kept")
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("_cp_gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their target words."""
    ship(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of at most 4096 ids, the ids with each piece."""
    ship(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
