"""Near-duplicate documents by MinHash.

1. Every text becomes the set of its word shingles (64-bit hashes). `bands * rows` universal hash
   functions give its minima; each band of `rows` minima gives one bucket key. Texts with equal
   sets share one node, named by a hash of the set.
2. Per bucket only its smallest node is found (combined before the shuffle), and the other members
   point to it. Large-star and small-star on these pointers give candidate groups: two nodes that
   share a bucket are always in one group. No pairs are written.
3. A group's whole texts meet in one task, or, beyond `tile_shingles`, in one task per pair of its
   tiles. There a pivot is compared with all members at once: signatures first, then full sets.
   Linked nodes merge; members of the largest merged part need no comparison of their own, all
   others become pivots. So every pair of a group that ends up apart was compared.
4. The confirmed links (at most two per member and task) go through large-star and small-star
   again.

Two texts with a similarity of exactly 0.8 share a bucket with a chance of 0.99992 (bands 40,
rows 7), at 0.85 of 1 - 1e-7; the signature filter lies five standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolsight.llm.components import connected
from poolsight.llm.words import byte_arrays, mix, shingle_set
from poolsight.session import cut

BANDS, ROWS = 40, 7
PERCENT = 80
#: Shingles of one tile; two tiles meet in a task.
TILE_SHINGLES = 1 << 21
SIGNS = "doc_id long, node long, n_shingles long, bands array<long>"


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    a = draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], draw.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of `n` functions a*x + b mod 2^32 over the upper halves of the hashes."""
    a, b = _functions(n)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        values = a * x[None, at : at + 512]
        values += b
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    rows = least.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def set_name(shingles: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int(mix(mix(shingles).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                nodes, sizes, keys = [], [], []
                for data in byte_arrays(batch.column(1)):
                    found = shingle_set(data, width)
                    sizes.append(len(found))
                    nodes.append(set_name(found) if len(found) else None)
                    keys.append(band_keys(minima(found, bands * rows), bands) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "node", "n_shingles", "bands"],
                )

    return run


def signatures(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (names the shingle set; null if it is empty), n_shingles and the bucket keys of each text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signatures(width, bands, rows), SIGNS)


def candidate_groups(signs: DataFrame) -> DataFrame:
    """(node, root): nodes joined through shared buckets; nodes that share none are absent."""
    keyed = signs.filter("doc_id is not null and node is not null").select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    points = keyed.join(shared.select("key", "least"), "key").filter("node <> least").select("node", "least").distinct()
    return connected(points)


class Forest:
    """Merged parts of the nodes 0..n-1."""

    def __init__(self, n: int):
        self.part = np.arange(n)

    def merge(self, members: np.ndarray) -> None:
        parts = np.unique(self.part[members])
        if len(parts) > 1:
            self.part[np.isin(self.part, parts)] = parts[0]

    def outside_largest(self) -> np.ndarray:
        count = np.bincount(self.part, minlength=len(self.part))
        return self.part != count.argmax()


def verified_links(sets: list[np.ndarray], percent: int, signs: int) -> np.ndarray:
    """Parts of a group that are linked by 100 * |A and B| >= percent * |A or B|, as one label per set.

    `signs` minima of each set are compared first.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    sketch = np.stack([minima(s, signs) for s in sets])
    slack = 5 * (percent / 100 * (1 - percent / 100) / signs) ** 0.5
    enough = (percent / 100 - slack) * signs
    flat = np.concatenate(sets)
    start = np.concatenate(([0], np.cumsum(size)))
    forest, done = Forest(n), np.zeros(n, bool)

    def probe(i: int) -> None:
        done[i] = True
        close = ((sketch == sketch[i]).sum(axis=1) >= enough) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        close &= forest.part != forest.part[i]
        other = np.flatnonzero(close)
        if not len(other):
            return
        pivot = sets[i]
        if len(other) < 32:
            both = np.array([np.isin(sets[j], pivot, assume_unique=True).sum() for j in other])
        else:
            chosen = np.concatenate([flat[start[j] : start[j + 1]] for j in other])
            at = np.minimum(np.searchsorted(pivot, chosen), len(pivot) - 1)
            hit = (pivot[at] == chosen).astype(np.int64)
            both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(size[other])[:-1])))
        linked = other[100 * both >= percent * (size[other] + size[i] - both)]
        if len(linked):
            forest.merge(np.append(linked, i))

    while True:
        left = np.flatnonzero(forest.outside_largest() & ~done)
        if not len(left):
            return forest.part
        if not done.any():
            # the first pivots: spread over the group, so that a group of near copies merges early
            for i in np.unique(np.linspace(0, n - 1, 8).astype(int)):
                probe(int(i))
            continue
        probe(int(left[0]))


def _verify(width: int, percent: int, signs: int):
    def links(rows: list[tuple[int, np.ndarray]]) -> tuple[list[int], list[int]]:
        by_node: dict[int, np.ndarray] = {}
        for node, data in rows:
            if node not in by_node:
                found = shingle_set(data, width)
                if len(found) and set_name(found) == node:
                    by_node[node] = found
        nodes = np.array(sorted(by_node), np.int64)
        if len(nodes) < 2:
            return [], []
        part = verified_links([by_node[x] for x in nodes.tolist()], percent, signs)
        lowest = np.full(len(part), len(part))
        np.minimum.at(lowest, part, np.arange(len(part)))
        roots = nodes[lowest[part]]
        moved = roots != nodes
        return nodes[moved].tolist(), roots[moved].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out_u, out_v = None, [], [], []

        def flush() -> None:
            if len(rows) > 1:
                u, v = links(rows)
                out_u.extend(u)
                out_v.extend(v)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for key, node, data in zip(keys, batch.column(3).to_pylist(), byte_arrays(batch.column(4))):
                if key != now:
                    flush()
                    now, rows = key, []
                rows.append((node, data.copy()))
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])
                out_u, out_v = [], []
        flush()
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return run


def confirmed_links(
    docs: DataFrame, signs: DataFrame, groups: DataFrame, width: int, percent: int, signs_n: int, tile_shingles: int
) -> DataFrame:
    """(u, v): links between nodes of one group, confirmed on the full sets of whole texts."""
    one = signs.filter("doc_id is not null and node is not null").groupBy("node").agg(
        F.min("doc_id").alias("_md_doc"), F.first("n_shingles").alias("n")
    )
    members = cut(groups.join(one, "node"))
    tiles = members.groupBy("root").agg(F.ceil(F.sum("n") / tile_shingles).alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda x: (x != tile) | (F.col("tiles") == 1))
    meets = F.transform(
        others,
        lambda other: F.struct(F.least(tile, other).alias("a"), F.greatest(tile, other).alias("b")),
    )
    placed = members.join(tiles, "root").select("_md_doc", "node", "root", F.inline(meets))
    texts = docs.select(F.col("doc_id").cast("long").alias("_md_doc"), "text").filter("_md_doc is not null")
    return (
        # a merge join at every size: the members' share of the documents decides nothing about the plan
        placed.hint("merge").join(texts, "_md_doc")
        .select("root", "a", "b", "node", "text")
        .repartition("root", "a", "b")
        .sortWithinPartitions("root", "a", "b")
        .mapInArrow(_verify(width, percent, signs_n), "u long, v long")
    )


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    tile_shingles: int = TILE_SHINGLES,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text, any other columns).

    Texts with fewer than `width` words are one shingle of all their words. Null, empty and blank
    texts have no shingles, link with nothing and are their own component. component_id is the
    smallest doc_id that links reach, kept says whether it is the row's own. Rows without doc_id
    link with nothing and are kept, component_id null. Rows that repeat a doc_id are one document
    if their texts agree; with different texts each takes the smaller of its own results' doc_ids.
    """
    signs = cut(signatures(docs, width, bands, rows))
    groups = cut(candidate_groups(signs))
    parts = connected(confirmed_links(docs, signs, groups, width, percent, bands * rows, tile_shingles))
    named = signs.select("doc_id", "node", "n_shingles").join(
        parts.withColumnRenamed("root", "_md_root"), signs["node"] == parts["node"], "left"
    ).select("doc_id", signs["node"], "n_shingles", F.coalesce("_md_root", signs["node"]).alias("part"))
    least = named.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("_md_least"))
    lone = F.col("doc_id").isNull() | F.col("part").isNull()
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("_md_least"))
    return named.join(least, "part", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )
