"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

Vectors become whole numbers and are cut into equal parts, each with a codebook of its own that some
rounds of k-means settle. Blocks of vectors are written once with a metric tree per part
(`metric_trees`); every round reads them, hands the current entries down the trees and returns one
sum and count per entry and task, which Spark adds up. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType

from poolsight.llm import metric_trees
from poolsight.llm.maxscore import finite
from poolsight.llm.runs import dense, key_runs
from poolsight.operators.joins import join_summary
from poolsight.session import cut

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components of a block of vectors, which is built and searched as one.
BLOCK_VALUES = 1 << 18
LONGEST = (1 << 63) - 1

_TREES = "array<struct<left:array<int>,right:array<int>,start:array<int>,stop:array<int>,order:array<int>,sums:array<double>,radius:array<double>>>"
_TREE_ARROW = pa.list_(
    pa.struct([(k, pa.list_(pa.int32())) for k in ("left", "right", "start", "stop", "order")] + [(k, pa.list_(pa.float64())) for k in ("sums", "radius")])
)


def whole(vectors: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), in float64 or, if `wide`, as Python integers."""
    if not wide:
        return np.floor(vectors * scale)
    return np.array([[floor(Fraction(x) * scale) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def _blocks(width: int, scale: int, parts: int, wide: bool, label: pa.DataType):
    rows_of_block = max(64, BLOCK_VALUES // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows_of_block - count)
                waiting.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == rows_of_block:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, count = [], 0
        if count:
            yield block(pa.Table.from_batches(waiting))

    def block(rows: pa.Table) -> pa.RecordBatch:
        vectors = dense(rows.column(2), width, np.float64)
        trees = []
        if not wide:
            values = whole(vectors, scale, wide)
            for part in np.split(values, parts, axis=1):
                tree = metric_trees.build(np.ascontiguousarray(part))
                trees.append({k: np.ravel(v) for k, v in tree._asdict().items()})
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows.column(0).combine_chunks()], pa.list_(pa.int64())),
                pa.array([rows.column(1).combine_chunks()], pa.list_(label)),
                pa.array([vectors.ravel()], pa.list_(pa.float64())),
                pa.array([trees], _TREE_ARROW),
            ],
            ["ids", "labels", "vectors", "trees"],
        )

    return run


def _read(batches: Iterator[pa.RecordBatch], width: int, scale: int, parts: int, wide: bool):
    """(record batch, row, parts of the block's vectors as whole numbers, trees) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            n = len(batch.column("ids")[i])
            values = whole(batch.column("vectors")[i].values.to_numpy().reshape(n, width), scale, wide)
            trees = []
            if not wide:
                stored = batch.column("trees")[i].values
                for p in range(parts):
                    fields = {k: stored.field(k)[p].values.to_numpy() for k in metric_trees.Tree._fields}
                    fields["sums"] = fields["sums"].reshape(len(fields["left"]), -1)
                    trees.append(metric_trees.Tree(**fields))
            yield batch, i, np.split(values, parts, axis=1), trees


def _totals(width: int, scale: int, books: list[np.ndarray], wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object if wide else np.float64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        long_sums = [np.zeros(b.shape, object) for b in books]
        for _, _, split, trees in _read(batches, width, scale, len(books), wide):
            for p, (points, book) in enumerate(zip(split, books)):
                if wide:
                    entry, _ = metric_trees.nearest_exact(points, book)
                    np.add.at(sums[p], entry, points)
                    np.add.at(counts[p], entry, 1)
                else:
                    found, n = metric_trees.totals(trees[p], points[trees[p].order], book)
                    sums[p] += found
                    counts[p] += n.astype(np.int64)
                    if np.abs(sums[p]).max(initial=0) > 2.0**51:  # before single steps are lost
                        long_sums[p] += sums[p].astype(np.int64).astype(object)
                        sums[p][:] = 0
        out = []
        for p, n in enumerate(counts):
            for e in np.flatnonzero(n):
                sum_of = [int(a) + int(b) for a, b in zip(sums[p][e], long_sums[p][e])]
                out.append((p, int(e), int(n[e]), [str(s) for s in sum_of]))
        if out:
            p, e, n, s = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.string()))],
                ["part", "entry", "n", "sums"],
            )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sorted (part, entry) rows, held one at a time."""
    now, n, sums = None, 0, []

    def row() -> pa.RecordBatch:
        columns = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([n], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    for batch in batches:
        for p, e, more, found in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "n", "sums"))):
            if (p, e) != now:
                if now is not None:
                    yield row()
                now, n, sums = (p, e), 0, [0] * len(found)
            n += more
            sums = [a + int(b) for a, b in zip(sums, found)]
    if now is not None:
        yield row()


def _codes(width: int, scale: int, books: list[np.ndarray], wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, split, trees in _read(batches, width, scale, len(books), wide):
            codes, error = [], np.zeros(len(split[0]), object if wide else np.float64)
            for p, (points, book) in enumerate(zip(split, books)):
                if wide:
                    entry, square = metric_trees.nearest_exact(points, book)
                else:
                    entry = metric_trees.nearest(trees[p], points[trees[p].order], book)
                    square = ((points - book[entry]) ** 2).sum(axis=1)
                codes.append(entry.astype(np.uint8))
                error += square
            packed = np.stack(codes, axis=1).tobytes().hex()
            size = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids")[i].values,
                    batch.column("labels")[i].values,
                    pa.array([packed[at : at + size] for at in range(0, len(packed), size)], pa.string()),
                    pa.array([min(int(x), LONGEST) for x in error], pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return run


def compress(
    vectors: DataFrame,
    label: str = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(codes, codebooks): vec_id, label, code, error of each usable row of `vectors`, and the final entries by part.

    Rows whose embedding is null or holds null or non-finite components are dropped; other columns are
    ignored and `label` (null if there is no such column) is passed on. Every component becomes
    floor(scale * x). Shorter vectors, also empty ones, count as padded with zeros, to a width that `parts` divides. Codebooks start
    as the parts of the rows with the `entries` smallest vec_id (repeated ids: by vector; null ids
    last), fewer if there are fewer rows; at most 256. Each round moves an entry to floor(sum / count)
    of its parts; entries without parts stay. Ties go to the lower entry. `error` is the squared
    distance to the chosen entries, at most 2^63 - 1. Numbers too large for exact double arithmetic go
    through Python integers, without trees. An empty table gives no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = vectors.sparkSession
    tag = F.col(label) if label in vectors.columns else F.lit(None).cast("int")
    kept = vectors.filter(finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), tag.alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    kind: DataType = kept.schema["label"].dataType
    schema = f"vec_id long, label {kind.simpleString()}, code string, error long"
    longest = F.array_max(F.transform("embedding", F.abs))
    width, most = kept.agg(F.max(F.size("embedding")), F.max(longest)).first()
    if width is None:
        return spark.createDataFrame([], schema), [[] for _ in range(parts)]
    width = max(1, -(-width // parts)) * parts
    # squared lengths, and twice a product, have to stay below 2^51
    wide = most is not None and (most > 1e100 or 8 * width * (most * scale + 1) ** 2 >= 2.0**51)
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    padded = np.array([list(r.embedding) + [0.0] * (width - len(r.embedding)) for r in start], float).reshape(len(start), width)
    books = np.split(whole(padded, scale, wide), parts, axis=1)

    label_arrow = _arrow_type(kind)
    blocks = cut(
        kept.mapInArrow(
            _blocks(width, scale, parts, wide, label_arrow),
            f"ids array<long>, labels array<{kind.simpleString()}>, vectors array<double>, trees {_TREES}",
        )
    )
    sums_schema = "part int, entry int, n long, sums array<string>"
    for _ in range(rounds):
        found = blocks.mapInArrow(_totals(width, scale, books, wide), sums_schema)
        added = found.repartition("part", "entry").sortWithinPartitions("part", "entry").mapInArrow(_add_up, sums_schema)
        moved = [b.copy() for b in books]
        for part, entry, n, sums in added.collect():  # at most parts * entries rows, in one job
            moved[part][entry] = [int(s) // n for s in sums]
        books = moved
    codes = blocks.mapInArrow(_codes(width, scale, books, wide), schema)
    return codes, [[[int(x) for x in e] for e in b] for b in books]


def _arrow_type(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    if isinstance(kind, ArrayType):
        raise ValueError("label must not be an array")
    return to_arrow_type(kind)


def digest(codebooks: list[list[list[int]]]) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in codebooks for entry in part for x in entry).encode()).hexdigest()


def label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with label_error, the error summed over equal labels (nulls together), at most 2^63 - 1."""
    summed = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_total"))
    total = F.least("_total", F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    return join_summary(codes, summed.select("label", total.alias("label_error")), ["label"], ["vec_id"])
