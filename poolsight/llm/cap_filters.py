"""Near-duplicate vectors by spherical-cap filters.

Filter directions are products of two random codes: after one random rotation a vector falls into
two halves, and every pair of a code for the first half and one for the second is a direction. A
vector's list is all directions whose inner product with it reaches a threshold. It is decoded from
the two code tables alone: only codes that can still reach the threshold with the other half's best
are combined. Codes and threshold follow from the number of vectors, so that a list has about
`expected` directions and unrelated vectors rarely meet. List lengths vary from vector to vector, so
`repeats` independent rotations and code pairs are used side by side.

Vectors with equal components are one node, named by a hash of them, with a count. The nodes of a filter meet in one task,
beyond `tile_rows` in one task per pair of tiles. A pair is counted at the smallest filter it shares
(one product of membership matrices tells), so no pair is ever written: a task returns per node how
many others it found and a root that links lead to.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolsight.llm.components import connected
from poolsight.llm.maxscore import usable
from poolsight.llm.runs import dense, whole_runs
from poolsight.session import cut

COSINE = 0.95
#: Filters of a vector on average in each of `REPEATS` independent code pairs, directions per vector.
EXPECTED, REPEATS, SPREAD = 12, 4, 20
TILE_ROWS = 1024
#: Rows read before their meetings are looked at, and the size up to which meetings are sifted together.
MEET_ROWS, SHORT_RUN = 4096, 24
SEED = 5


@lru_cache(maxsize=8)
def filters(width: int, codes: int, expected: float, repeat: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rotation, the two code tables and the threshold that gives `expected` directions on average."""
    draw = np.random.default_rng(SEED + repeat)
    rotation = np.linalg.qr(draw.standard_normal((width, width)))[0]
    half = width // 2
    tables = []
    for size in (half, width - half):
        table = draw.standard_normal((codes, max(size, 1)))
        tables.append(table / np.linalg.norm(table, axis=1, keepdims=True))
    tries = draw.standard_normal((200, width))
    tries = tries / np.linalg.norm(tries, axis=1, keepdims=True) @ rotation
    first, second = (tries[:, :half] @ tables[0].T if half else np.zeros((200, codes))), tries[:, half:] @ tables[1].T
    second.sort(axis=1)
    low, high = 0.0, 2.0
    for _ in range(30):
        t = (low + high) / 2
        count = sum((codes - np.searchsorted(s, t - f)).sum() for f, s in zip(first, second)) / len(tries)
        low, high = (t, high) if count > expected else (low, t)
    return rotation, tables[0], tables[1], high


def decode(vectors: np.ndarray, codes: int, expected: float, repeats: int) -> list[np.ndarray]:
    """The sorted filter numbers of each unit vector, over all code pairs."""
    lists = [_decode_one(vectors, codes, expected, r) for r in range(repeats)]
    return [np.concatenate([found + r * codes * codes for r, found in enumerate(of)]) for of in zip(*lists)]


def _decode_one(vectors: np.ndarray, codes: int, expected: float, repeat: int) -> list[np.ndarray]:
    rotation, left, right, t = filters(vectors.shape[1], codes, expected, repeat)
    turned = vectors @ rotation
    half = vectors.shape[1] // 2
    first = turned[:, :half] @ left.T if half else np.zeros((len(turned), codes))
    second = turned[:, half:] @ right.T
    out = []
    for f, s, most_f, most_s in zip(first, second, first.max(axis=1), second.max(axis=1)):
        i, j = np.flatnonzero(f >= t - most_s), np.flatnonzero(s >= t - most_f)
        a, b = np.nonzero(f[i][:, None] + s[j][None, :] >= t)
        out.append(np.sort(i[a].astype(np.int64) * codes + j[b]))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _decode(width: int, codes: int, expected: float, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                vectors = _unit(dense(pa.chunked_array([part.column(2)]), width, np.float64))
                lists = pa.array(decode(vectors, codes, expected, repeats), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["node", "copies", "embedding", "filters"])

    return run


def linked_parts(linked: np.ndarray) -> np.ndarray:
    """The smallest index that links lead to, for each row of a symmetric matrix."""
    part = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        after = np.where(reach, part[None, :], len(part)).min(axis=1)
        after = after[after]
        if (after == part).all():
            return part
        part = after


def _meet(width: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, 3, MEET_ROWS):
            unit = _unit(dense(table.column(6), width, np.float64))
            here, a, b = (table.column(i).to_numpy() for i in range(3))
            # most filters hold no link: small ones are told apart by all their pairs at once
            for i in _runs_with_pairs(unit, starts, cosine):
                first, stop = starts[i], starts[i + 1]
                found = _links(table.slice(first, stop - first), unit[first:stop], here[first], a[first] != b[first], cosine)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "links", "root"])

    return run


def _runs_with_pairs(unit: np.ndarray, starts: np.ndarray, cosine: float) -> np.ndarray:
    """The runs that may hold a link: all long ones, and the short ones in which one does."""
    sizes = np.diff(starts)
    maybe = sizes > SHORT_RUN
    for size in range(2, SHORT_RUN + 1):
        runs = np.flatnonzero(sizes == size)
        for part in np.array_split(runs, max(1, len(runs) * size // MEET_ROWS)):
            rows = unit[starts[part, None] + np.arange(size)]
            close = np.einsum("rid,rjd->rij", rows, rows) >= cosine * (1 - 1e-12)
            maybe[part] = close[:, *np.triu_indices(size, 1)].any(axis=1)
    return np.flatnonzero(maybe)


def _links(rows: pa.Table, unit: np.ndarray, here: int, tiles: bool, cosine: float) -> tuple[np.ndarray, ...] | None:
    """(node, links, root) of the vectors of one meeting that link there and met in no filter before."""
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if tiles:
        tile = rows.column(3).to_numpy()
        linked &= tile[:, None] != tile[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    linked = linked[np.ix_(some, some)] & ~_shared_before(rows.column(7).take(pa.array(some)), here)
    node, copies = (rows.column(i).to_numpy()[some] for i in (4, 5))
    order = np.argsort(node, kind="stable")
    links = linked @ copies
    linked, named, links = linked[np.ix_(order, order)], node[order], links[order]
    kept = links > 0
    return (named[kept], links[kept], named[linked_parts(linked)][kept]) if kept.any() else None


def _shared_before(column: pa.ChunkedArray, here: int) -> np.ndarray:
    """Whether two vectors share a filter below `here`, where they have met already."""
    lists = column.combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    number = lists.flatten().to_numpy()
    owner, number = owner[number < here], number[number < here]
    names, at, count = np.unique(number, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    owner, at = owner[place[at] >= 0], place[at][place[at] >= 0]
    out = np.zeros((len(lists), len(lists)), bool)
    for begin in range(0, len(shared), 4096):  # bounded columns at a time
        part = (at >= begin) & (at < begin + 4096)
        member = np.zeros((len(lists), min(4096, len(shared) - begin)), np.float32)
        member[owner[part], at[part] - begin] = 1
        out |= member @ member.T > 0
    return out


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    expected: float = EXPECTED,
    repeats: int = REPEATS,
    spread: int = SPREAD,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, any other columns).

    Pairs count as linked if found and their cosine, in double precision, reaches `cosine`; none
    below it is ever linked. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and so do rows without vec_id (component_id null, kept). A shorter vector
    counts as padded with zeros. Rows that repeat a vec_id are separate vectors of that id. An empty
    table gives no rows, and vectors of any length are compared whole.
    """
    e = F.col("embedding")
    good = usable(e) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = cut(
        vectors.select(
            F.col("vec_id").cast("long"), e, F.coalesce(good, F.lit(False)).alias("good"), F.xxhash64(e).alias("node")
        )
    )
    nodes = cut(
        rows.filter("good")
        .groupBy("node")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )
    n, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    codes = max(64, int(np.ceil((spread * n) ** 0.5)))
    decoded = cut(
        nodes.select("node", "copies", "embedding").mapInArrow(
            _decode(width, codes, expected, repeats),
            f"node long, copies long, embedding {rows.schema['embedding'].dataType.simpleString()}, filters array<long>",
        )
    )
    listed = decoded.select("node", F.explode("filters").alias("filter"))
    full = listed.groupBy("filter").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile_rows)
    tile: Column = F.pmod(F.xxhash64("node"), F.col("tiles"))
    others = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    meets = F.transform(others, lambda x: F.struct(F.least("tile", x).alias("a"), F.greatest("tile", x).alias("b")))
    placed = (
        listed.join(full, "filter")
        .withColumn("tiles", tiles)
        .withColumn("tile", tile)
        .select("filter", "node", "tile", F.inline(meets))
    )
    found = (
        placed.join(decoded, "node")
        .select("filter", "a", "b", "tile", "node", "copies", "embedding", "filters")
        .repartition("filter", "a", "b")
        .sortWithinPartitions("filter", "a", "b")
        .mapInArrow(_meet(width, cosine), "node long, links long, root long")
    )
    found = cut(found)
    parts = connected(found.select("node", "root")).withColumnRenamed("root", "part")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classed = cut(
        nodes.drop("embedding").join(links, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    )
    least = classed.groupBy("part").agg(F.min("first_id").alias("least"))
    joined = rows.drop("embedding").join(classed.join(least, "part").select("node", "copies", "links", "least"), "node", "left")
    component = F.when(F.col("good"), F.col("least")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"),
    )
