"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from poolsight.session import cut

SALTS = 64
#: A key with more rows than this on the left side is spread over several tasks.
HOT_ROWS = 1 << 20


def join_on(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which a null key meets a null key; the keys appear once."""
    named = {k: f"_on_{k}" for k in keys}
    right = other.withColumnsRenamed(named)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return df.join(right, same, how).drop(*named.values())


def broadcast_limit(df: DataFrame) -> int:
    """The session's own limit for broadcasts, in bytes (-1 turns them off)."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text[:-1]) * units[text[-1]] if text[-1:] in units else int(text)


def stored_bytes(df: DataFrame) -> int:
    """Size of a stored table as the optimizer sees it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_summary(
    rows: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table with one row per key.

    The summary is written first, so its size is known: within the broadcast limit the rows
    are not shuffled at all. Beyond it every summary row is copied `salts` times and the rows
    of a key spread over as many tasks, by a hash of `spread_by`.
    """
    return join_stored(rows, cut(summary), keys, spread_by, how, salts)


def join_stored(
    rows: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """`join_summary` for a summary that has been written already."""
    keys = list(keys)
    if stored_bytes(stored) <= broadcast_limit(rows):
        return join_on(rows, F.broadcast(stored), keys, how)
    copies = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return join_on(salted, copies, [*keys, "_salt"], how).drop("_salt")


def join_skewed(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], spread_by: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join where single keys of `rows` may be hot and `other` has few rows per key.

    Only the rows of `other` with a hot key are copied, once per `hot_rows` rows of that key.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = cut(counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices")))
    if hot.isEmpty():
        return join_on(rows, other, keys)
    slices = F.coalesce("_slices", F.lit(1))
    left = join_stored(rows, hot, keys, spread_by, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int")
    )
    right = join_on(other, hot, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return join_on(left.drop("_slices"), right.drop("_slices"), [*keys, "_slice"]).drop("_slice")


def join_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of a table of one row beside every row.

    The row is written first, so its size is known; it is broadcast only within the session's limit, and
    streamed to the tasks beyond it.
    """
    stored = cut(one)
    small = stored_bytes(stored) <= broadcast_limit(rows)
    return rows.crossJoin(F.broadcast(stored) if small else stored.hint("shuffle_replicate_nl"))
