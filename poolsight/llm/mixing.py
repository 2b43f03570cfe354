"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Every document of a source has the same expected number
of copies, target / source size; along the source's documents, ordered by size and doc_id, these
are summed up from one random offset, and a document is taken once for each integer passed. Equal
steps along the sizes keep the words taken within about one large document of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolsight.llm.ranks import ranked
from poolsight.session import cut

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add `target` to one row per source (`source`, `source_size`, no repeats).

    Weights go round the sources by code point, null last. Sources share the total by weight; a
    source above `max_repeat` times its size stays there. With sources ordered by size per weight,
    those at their limit come first, so the share per weight of the rest follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "nr")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighted = sources.withColumn("nr", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("nr") - 1, F.lit(len(weights))) + 1)
    )
    rest_size = F.sum("source_size").over(everything) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = weighted.withColumn("share", rest_size / rest_weight)
    below = F.when(F.col("share") * F.col("weight") <= max_repeat * F.col("source_size"), F.col("share"))
    return shared.withColumn("final", F.first(below, ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn(
        "target", F.least(F.col("final") * F.col("weight"), (max_repeat * F.col("source_size")).cast("double"))
    ).select("source", "source_size", "target")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= copies * size), text_name: a row per row of `docs`.

    Null and empty texts have size 0; a source of such texts only has target 0 and no copies. Null
    sources form one source, null doc_ids sort first inside a source. Repeated rows are separate
    documents. The same rows and seed always give the same copies.
    """
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long"),
            "source",
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_name"),
        )
    ).withColumns({"no_source": F.col("source").isNull(), "named": F.coalesce("source", F.lit(""))})
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, max_repeat).withColumn(
        "start", (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10).cast("double") + 0.5) / 65536
    ).select(F.col("source").alias("_mx_source"), "source_size", "target", "start")
    placed = ranked(sized, ["no_source", "named"], ["size", "doc_id", "text_name"], "nr")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passed = F.floor(step * (F.col("nr") + 1) + F.col("start")) - F.floor(step * F.col("nr") + F.col("start"))
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_mx_source")))
        .withColumn("copies", F.least(passed, F.lit(max_repeat).cast("long")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_name")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """`docs` with each row as often as the mix takes it.

    Rows that agree in doc_id, source and text are repeats of one document; what the mix takes of
    them in total is taken of one of them.
    """
    keys = {"_mx_id": F.col("doc_id").cast("long"), "_mx_from": F.col("source"), "_mx_name": F.xxhash64(F.coalesce("text", F.lit("")))}
    taken = (
        mix(docs, weights, max_repeat, seed)
        .groupBy("doc_id", "source", "text_name")
        .agg(F.sum("copies").alias("_mx_copies"))
        .filter("_mx_copies > 0")
        .select(F.col("doc_id").alias("_mx_a"), F.col("source").alias("_mx_b"), F.col("text_name").alias("_mx_c"), "_mx_copies")
    )
    same = F.col("_mx_id").eqNullSafe(F.col("_mx_a")) & F.col("_mx_from").eqNullSafe(F.col("_mx_b")) & (F.col("_mx_name") == F.col("_mx_c"))
    repeats = Window.partitionBy("_mx_id", "_mx_from", "_mx_name").orderBy(F.lit(0))
    return (
        docs.withColumns(keys)
        .join(taken, same)
        .withColumn("_mx_row", F.row_number().over(repeats))
        .filter("_mx_row = 1")
        .withColumn("_mx_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mx_copies"))))
        .select(*docs.columns)
    )
