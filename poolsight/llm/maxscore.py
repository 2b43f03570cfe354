"""Exact top-k by inner product with MaxScore.

Candidates are dealt by similarity: every row goes to the cell of its nearest pivot, and cells are cut
into shards. A first look at a bounded set of seed rows gives each query a floor: the score of its
k-th best seed. A cell whose best possible score, from its largest and smallest components, lies below
the floor is dropped for that query before anything is copied. In a shard a query's components are
sorted by the largest product any of its rows can add. The smallest of them, as long as their sum
cannot lift a row without the others to the floor, are non-essential. The postings of the essential
components are traversed for a block of queries at once, as a product of matrices; rows that can still
reach the floor are probed in the other components, strongest first, and dropped once they cannot. The
best rows of all shards meet in one window per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from poolsight.llm.runs import dense, key_runs
from poolsight.session import cut

#: Rows of a shard, queries handled as one matrix, and queries that share a copy of a shard.
SHARD_ROWS, BLOCK_QUERIES, GROUP_QUERIES = 4096, 256, 1 << 18
#: Most cells, and most components of all seed rows together, which are sent to every task.
CELLS, SEED_VALUES = 64, 1 << 18
STEP = 8
#: Bounds of all non-essential components stay below the floor divided by this: a row without essential
#: products cannot reach the floor, and few others have to be probed.
SHARE = 4
LARGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Not null, and all components finite numbers; true for an empty vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def usable(vector: Column) -> Column:
    """Finite and not empty."""
    return finite(vector) & (F.size(vector) > 0)


def _kind(largest: int, width: int) -> type:
    """A number type in which inner products of such components are exact."""
    bound = width * largest * largest
    return np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return dense(column, width, np.int64).astype(kind)


def _as_long(scores: np.ndarray) -> np.ndarray:
    """64-bit scores; larger ones stop at the limits."""
    if scores.dtype == object:
        return np.array([max(-LARGEST, min(int(s), LARGEST)) for s in scores], np.int64)
    return scores.astype(np.int64)


def _same(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows == query).all(axis=1)


class Shard:
    """Candidates of one shard with the range of each component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.highest, self.lowest = rows.max(axis=0), rows.min(axis=0)
        self.order = np.argsort(ids, kind="stable")

    def own(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Position of each query's own row (equal id and vector), -1 without."""
        out = np.full(len(ids), -1)
        sorted_ids = self.ids[self.order]
        for i, (a, b) in enumerate(zip(np.searchsorted(sorted_ids, ids), np.searchsorted(sorted_ids, ids, side="right"))):
            if a < b:
                here = self.order[a:b]
                equal = here[_same(self.rows[here], queries[i])]
                out[i] = equal[0] if len(equal) else -1
        return out

    def top(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, known: np.ndarray, k: int):
        """(query, row, score) of the k best rows of every query, ties to smaller ids; rows below a known floor may be absent."""
        count, width = queries.shape
        bound = np.maximum(queries * self.highest, queries * self.lowest)
        order = np.argsort(bound, axis=1, kind="stable")
        ascending = np.take_along_axis(bound, order, axis=1)
        rest = np.cumsum(ascending, axis=1)
        optional = (rest * SHARE < floors[:, None]) & known[:, None]
        spare = optional.cumprod(axis=1).sum(axis=1) if width else np.zeros(count, np.int64)
        essential = np.ones((count, width), bool)
        np.put_along_axis(essential, order, np.arange(width)[None, :] >= spare[:, None], axis=1)
        reached = (queries * essential) @ self.rows.T  # essential postings
        left = np.array([rest[i, s - 1] if s else 0 for i, s in enumerate(spare)], rest.dtype)
        own = self.own(ids, queries)
        alive = reached + left[:, None] >= np.where(known, floors, 0)[:, None]
        alive[~known] = True
        alive[np.arange(count)[own >= 0], own[own >= 0]] = False
        q, x = np.nonzero(alive)
        score, slack = reached[q, x], left[q]
        for at in range(int(spare.max(initial=0)), 0, -STEP):  # the others, strongest first
            part = np.arange(max(at - STEP, 0), at)
            open_part = part[None, :] < spare[q][:, None]
            names = order[q][:, part]
            exact = np.where(open_part, queries[q[:, None], names] * self.rows[x[:, None], names], 0)
            bounds = np.where(open_part, bound[q[:, None], names], 0)
            score, slack = score + exact.sum(axis=1), slack - bounds.sum(axis=1)
            keep = (score + slack >= floors[q]) | ~known[q]
            q, x, score, slack = q[keep], x[keep], score[keep], slack[keep]
        keep = (score >= floors[q]) | ~known[q]
        q, x, score = q[keep], x[keep], _as_long(score[keep])
        best = np.lexsort((self.ids[x], -score, q))
        q, x, score = q[best], x[best], score[best]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], x[rank < k], score[rank < k]


def _look(seed_ids: np.ndarray, seeds: np.ndarray, ranges: list, k: int, width: int, kind: type):
    """Give every query its floor and the cells that can hold better rows."""
    highest = np.array([r[0] for r in ranges], kind).reshape(len(ranges), width)
    lowest = np.array([r[1] for r in ranges], kind).reshape(len(ranges), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_QUERIES):
                batch = whole.slice(at, BLOCK_QUERIES)
                ids, queries = batch.column(1).to_numpy(), _matrix(pa.chunked_array([batch.column(2)]), width, kind)
                score = queries @ seeds.T
                floors, known = np.zeros(len(ids), kind), np.zeros(len(ids), bool)
                for i in range(len(ids)):
                    others = np.ones(len(seeds), bool)
                    own = np.flatnonzero((seed_ids == ids[i]) & _same(seeds, queries[i]))
                    others[own[:1]] = False
                    if others.sum() >= k:
                        floors[i] = min(np.sort(score[i][others])[-k], LARGEST)
                        known[i] = floors[i] > -LARGEST
                most = np.maximum(queries, 0) @ highest.T + np.minimum(queries, 0) @ lowest.T
                open_cells = (most >= floors[:, None]) | ~known[:, None]
                cells = [np.flatnonzero(row) for row in open_cells]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array([str(f) if ok else None for f, ok in zip([int(f) for f in floors], known)], pa.string()),
                        pa.array(cells, pa.list_(pa.int32())),
                    ],
                    ["row", "vec_id", "vector", "floor", "cells"],
                )

    return run


def _place(pivots: np.ndarray, width: int):
    """Add the nearest pivot's number to every row."""
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = dense(pa.chunked_array([batch.column(1)]), width, np.float64)
            cell = (rows @ pivots.T - half).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["vec_id", "vector", "cell"])

    return run


def _ranges(width: int):
    """Rows and component ranges of each cell, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            cells, rows = batch.column(1).to_numpy(), dense(pa.chunked_array([batch.column(0)]), width, np.int64)
            for cell in np.unique(cells):
                here = rows[cells == cell]
                n, high, low = found.get(int(cell), [0, here[0], here[0]])
                found[int(cell)] = [n + len(here), np.maximum(high, here.max(axis=0)), np.minimum(low, here.min(axis=0))]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.int32()),
                    pa.array([f[0] for f in found.values()], pa.int64()),
                    pa.array([f[1] for f in found.values()], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found.values()], pa.list_(pa.int64())),
                ],
                ["cell", "n", "highest", "lowest"],
            )

    return run


def _search(k: int, width: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shard = None, None
        for (cell, sub, group, block), rows in key_runs(batches, 4):
            if block < 0:
                place = (cell, sub, group)
                shard = Shard(rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"), width, kind))
                continue
            if place != (cell, sub, group):
                continue  # no candidates here
            for at in range(0, rows.num_rows, BLOCK_QUERIES):
                part = rows.slice(at, BLOCK_QUERIES)
                floors = [None if f is None else int(f) for f in part.column("floor").to_pylist()]
                known = np.array([f is not None for f in floors])
                ids = part.column("vec_id").to_numpy()
                queries = _matrix(part.column("vector"), width, kind)
                q, x, score = shard.top(ids, queries, np.array([f or 0 for f in floors], kind), known, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("row").to_numpy()[q]), pa.array(ids[q]), pa.array(shard.ids[x]), pa.array(score)],
                    ["row", "query_id", "vec_id", "score"],
                )

    return run


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = 4 * BLOCK_QUERIES,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row, fewer if there are fewer.

    Both tables have vec_id and `vector`, an array of 64-bit whole numbers; a shorter vector, also an
    empty one, counts as padded with zeros; other columns are ignored. A query's own row, which is one
    candidate equal in vec_id and vector, is left out; repeated rows beyond it are candidates like any
    other, and repeated query rows get their answers each. Ties go to smaller vec_ids. Rows with a null
    vec_id, null vector or null component take no part; empty tables give no rows. Scores are exact;
    those beyond 64 bits stop at the limits.
    """
    spark = candidates.sparkSession
    fit = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", F.isnull)

    def picked(df: DataFrame) -> DataFrame:
        return df.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<bigint>").alias("vector"))

    pool, asked = cut(picked(candidates)), cut(picked(queries).select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"))
    far = F.array_max(F.transform("vector", lambda x: F.when(x == F.lit(-LARGEST - 1), F.lit(LARGEST)).otherwise(F.abs(x))))
    size = [F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(far), F.lit(0))]
    (n, width, most), (m, wide, largest) = pool.agg(*size).first(), asked.agg(*size).first()
    width, kind = max(width, wide, 1), _kind(max(most, largest) + 1, max(width, wide, 1))
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # seeds are the rows first in the order of a hash, so they are the same at every run
    taken = max(64, SEED_VALUES // width)
    sample = pool.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(taken).collect()
    seeds = np.array([list(r.vector) + [0] * (width - len(r.vector)) for r in sample], np.int64).astype(kind)
    seed_ids = np.array([r.vec_id for r in sample], np.int64)
    cells = max(1, min(CELLS, -(-n // shard_rows), len(seeds)))
    vector = "array<bigint>"
    placed = cut(pool.mapInArrow(_place(seeds[:cells].astype(np.float64), width), f"vec_id long, vector {vector}, cell int"))
    ranges = (
        placed.select("vector", "cell")
        .mapInArrow(_ranges(width), f"cell int, n long, highest {vector}, lowest {vector}")
        .select("cell", "n", F.posexplode(F.arrays_zip("highest", "lowest")).alias("at", "range"))
        .groupBy("cell", "at")
        .agg(F.sum("n").alias("n"), F.max("range.highest").alias("high"), F.min("range.lowest").alias("low"))
        .groupBy("cell")
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "high", "low"))).alias("ranges"))
        .collect()  # one row per cell
    )
    subs, limits = [0] * cells, [([0] * width, [0] * width)] * cells
    for r in ranges:
        subs[r.cell] = -(-r.n // shard_rows)
        limits[r.cell] = ([x.high for x in r.ranges], [x.low for x in r.ranges])

    groups, blocks = -(-m // group_queries), -(-min(m, group_queries) // block_queries)
    sub_count = F.array(*[F.lit(s) for s in subs])
    looked = asked.mapInArrow(
        _look(seed_ids, seeds, limits, k, width, kind), f"row long, vec_id long, vector {vector}, floor string, cells array<int>"
    )
    wanted = (
        looked.select("row", "vec_id", "vector", "floor", F.explode("cells").alias("cell"))
        .withColumn("subs", F.get(sub_count, F.col("cell")))
        .filter("subs > 0")
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .select(
            "cell",
            "sub",
            F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"),
            F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
            "row", "vec_id", "vector", "floor",
        )
    )
    held = placed.select(
        "cell",
        F.pmod(F.xxhash64("vec_id", "vector"), F.get(sub_count, F.col("cell")).cast("long")).cast("int").alias("sub"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(-1).alias("block"),
        F.lit(-1).cast("long").alias("row"), "vec_id", "vector", F.lit(None).cast("string").alias("floor"),
    )
    found = (
        held.union(wanted)
        .repartition(max(1, sum(subs) * groups), "cell", "sub", "group")
        .sortWithinPartitions("cell", "sub", "group", "block")
        .mapInArrow(_search(k, width, kind), "row long, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of every component, for rows whose components are all finite.

    What lies beyond 64 bits becomes the largest or smallest 64-bit number.
    """
    return vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )
