"""Cluster validation on flattened series: columns `id`, `vec array<double>`, `label`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from poolsight.operators.joins import join_row

#: Points of a tile at most, tiles at least, and points that make another tile worth while.
TILE_ROWS, TILES, LEAST_ROWS = 1 << 16, 16, 1024
#: Squared distances below this part of the squared lengths are computed from differences.
CLOSE = 1e-6


def _clusters(points: DataFrame) -> DataFrame:
    """Size, mean vector and summed squared deviation per cluster; map-side combined."""
    vec = array_to_vector("vec")
    stats = points.groupBy("label").agg(
        F.count("*").alias("n"),
        Summarizer.mean(vec).alias("mean"),
        Summarizer.variance(vec).alias("variance"),
    )
    spread = F.aggregate(vector_to_array("variance"), F.lit(0.0), lambda a, v: a + v)
    return stats.select(
        "label", "n", vector_to_array("mean").alias("mean"), (spread * (F.col("n") - 1)).alias("within")
    )


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between over within dispersion, times (n - k) / (k - 1); one pass and k rows."""
    clusters = _clusters(points)
    means = clusters.select("label", "n", "within", F.posexplode("mean").alias("dim", "m"))
    per_dim = means.groupBy("dim").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("k"),
        F.sum(F.col("m") * F.col("n")).alias("weighted"),
        F.collect_list(F.struct("n", "m", "within")).alias("parts"),
    )
    centre = F.col("weighted") / F.col("total")
    between = F.aggregate(
        "parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["m"] - F.col("centre")) * (p["m"] - F.col("centre"))
    )
    within = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["within"])
    summed = (
        per_dim.withColumn("centre", centre)
        .select("total", "k", between.alias("between"), within.alias("within"))
        .agg(F.max("total").alias("n"), F.max("k").alias("k"), F.sum("between").alias("b"), F.max("within").alias("w"))
    )
    n, k = F.col("n"), F.col("k")
    score = F.when(
        (k > 1) & (n > k),
        F.when(F.col("w") == 0, F.lit(1.0)).otherwise(
            F.col("b") / F.when(F.col("w") != 0, F.col("w")) * (n - k) / F.when(k > 1, k - 1)
        ),
    )
    return summed.select(n.alias("n"), k.alias("k"), score.alias("calinski_harabasz"))


def silhouette_sq(points: DataFrame) -> DataFrame:
    """Mean silhouette under *squared* Euclidean distance, linear in the number of points.

    The mean squared distance from x to a cluster is |x - mean|^2 plus the cluster's variance,
    so each point meets k cluster rows instead of n points.
    """
    clusters = _clusters(points).select(
        F.col("label").alias("other"), F.col("n"), F.col("mean"), (F.col("within") / F.col("n")).alias("spread")
    )
    packed = clusters.agg(F.collect_list(F.struct("other", "n", "mean", "spread")).alias("clusters"))
    joined = join_row(points, packed)
    gap = lambda c: F.aggregate(
        F.zip_with("vec", c["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v
    )
    scored = joined.select(
        "label",
        F.transform("clusters", lambda c: F.struct(c["other"].alias("other"), c["n"].alias("n"), (gap(c) + c["spread"]).alias("d"))).alias("ds"),
    )
    own = F.filter("ds", lambda d: d["other"] == F.col("label"))[0]
    others = F.filter("ds", lambda d: d["other"] != F.col("label"))
    a = own["d"] * own["n"] / F.when(own["n"] > 1, own["n"] - 1)
    b = F.array_min(F.transform(others, lambda d: d["d"]))
    top = F.greatest(F.col("a"), F.col("b"))
    value = F.when(F.col("n") == 1, F.lit(0.0)).when(top > 0, (F.col("b") - F.col("a")) / F.when(top > 0, top)).otherwise(0.0)
    return scored.select(own["n"].alias("n"), a.alias("a"), b.alias("b")).agg(F.avg(value).alias("silhouette_sq"))


def quadratic_silhouette(points: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """Exact mean silhouette under Euclidean distance, in work that grows with the square of the points.

    Every distance has to be looked at, but no pair becomes a row: points are dealt into tiles, one task
    handles one pair of tiles, computes each distance once for both its ends, and emits one distance sum per
    point and cluster of the other tile. Up to `TILES` tiles of `TILE_ROWS` points every point is copied
    `TILES` + 1 times, whatever their number. For more points than a million use `silhouette_sq`.
    """
    n = points.count()
    tiles = max(1, -(-n // (tile_rows or TILE_ROWS)), 1 if tile_rows else min(TILES, -(-n // LEAST_ROWS)))
    id_type = dict(points.dtypes)["id"]
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    dealt = points.select(
        "id", F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec"), tile.alias("tile")
    )
    against = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    pairs = dealt.withColumn("against", against).select(
        "id", "label", "vec", F.least("tile", "against").alias("ti"), F.greatest("tile", "against").alias("tj"), (F.col("tile") <= F.col("against")).alias("is_left")
    )
    sums = (
        pairs.repartition(tiles * (tiles + 1) // 2, "ti", "tj")
        .groupBy("ti", "tj")
        .applyInArrow(_tile_sums, f"id {id_type}, label int, other int, total double, n long")
    )
    per_cluster = sums.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("other")
    per_point = per_cluster.groupBy("id").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / F.when(F.col("n") > 1, F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    top = F.greatest("a", "b")
    value = F.when(F.col("size") == 1, F.lit(0.0)).when(top > 0, (F.col("b") - F.col("a")) / F.when(top > 0, top)).otherwise(0.0)
    return per_point.agg(F.avg(value).alias("silhouette"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of `a` to all of `b`, through inner products; close pairs again through their differences.

    Inner products lose the digits that two vectors share, so what is left has to be no small part of their lengths.
    """
    with np.errstate(invalid="ignore", over="ignore"):  # what comes out unusable is computed again
        lengths = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
        squares = a @ b.T
        squares *= -2.0
        squares += lengths
        lengths *= CLOSE
    row, col = np.nonzero(~(squares > lengths))
    step = max(1, (1 << 20) // max(1, a.shape[1]))
    for at in range(0, len(row), step):
        i, j = row[at : at + step], col[at : at + step]
        gap = a[i] - b[j]
        squares[i, j] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(squares, out=squares)


def _tile_sums(pair: pa.Table) -> pa.Table:
    """Distance sums of the points of a pair of tiles to the clusters of the other one, or of the one tile to its own."""
    kind = pair.schema.field("id").type
    sides = []
    for side in (pair.filter(pair["is_left"]), pair.filter(pc.invert(pair["is_left"]))):
        vec = side["vec"].combine_chunks()
        values = vec.flatten().to_numpy().reshape(len(side), -1) if len(side) else np.zeros((0, 0))
        label = side["label"].combine_chunks()
        known = np.unique(label.drop_null().to_numpy())
        members = label.to_numpy(zero_copy_only=False)[:, None] == known[None, :]
        sides.append((side, values, known, members.astype(float)))
    within = pair["ti"][0] == pair["tj"][0]
    (_, a, _, of_a), (_, b, _, of_b) = (sides[0], sides[0]) if within else sides
    to_b, to_a = np.zeros((len(a), of_b.shape[1])), np.zeros((len(b), of_a.shape[1]))
    if len(a) and len(b):
        for i in range(0, len(a), 512):
            for j in range(0, len(b), 1024):
                here = _distances(a[i : i + 512], b[j : j + 1024])
                to_b[i : i + 512] += here @ of_b[j : j + 1024]
                if not within:
                    to_a[j : j + 1024] += here.T @ of_a[i : i + 512]
    found = [(sides[0], to_b, sides[0 if within else 1])]
    if not within:
        found.append((sides[1], to_a, sides[0]))
    out = []
    for (side, *_), totals, (_, _, known, members) in found:
        rows = pa.array(np.repeat(np.arange(len(side)), len(known)))
        out.append(
            pa.table(
                {
                    "id": side["id"].take(rows),
                    "label": side["label"].take(rows),
                    "other": pa.array(np.tile(known, len(side)), pa.int32()),
                    "total": pa.array(totals.ravel(), pa.float64()),
                    "n": pa.array(np.tile(members.sum(axis=0), len(side)).astype(np.int64), pa.int64()),
                }
            )
        )
    return pa.concat_tables(out).cast(pa.schema([("id", kind), ("label", pa.int32()), ("other", pa.int32()), ("total", pa.float64()), ("n", pa.int64())]))
