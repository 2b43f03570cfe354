"""Exact nearest-neighbour graphs per layer without comparing all pairs.

Points at the same position become one spot that keeps its smallest ids: beyond k + 1 no other point
there can be among anybody's k nearest. The spots of a layer are cut by a k-d tree whose planes lie
at medians, taken from a bounded sample of each crowded cell, until a leaf holds at most `leaf_rows`
spots. Distinct positions can always be parted, so no spread, outlier or dense core stops that. A
spot finds its neighbours in its own leaf first; the distance to the last of them bounds the search,
and only leaves whose bounding box this ball touches are searched as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from poolsight.operators.joins import join_on, join_skewed, join_stored
from poolsight.schema import LAYER, keyed
from poolsight.session import cut

K = 5
LEAF_ROWS = 1024
QUERY_ROWS = 8192
#: Children of a cell at most, and spots of a crowded cell from which its planes are taken.
FAN, SAMPLE = 1024, 1 << 14
#: Rows that a task looks at together, and distances held at once.
STREAM_ROWS, CELLS = 1 << 15, 1 << 19
AXES = ["x", "y", "z"]
#: A leaf is named by its path of child numbers from the root of its layer, which is the empty text.
LEAF = [*LAYER, "cell"]
BOX = [f"{a}{end}" for a in AXES for end in ("0", "1")]
#: Slack for rounding when a ball is compared with a box.
SLACK = 1e-9


def node_features(cloud: DataFrame) -> DataFrame:
    """Features and position of each node; `node` is the row's place in its layer."""
    return keyed(cloud).select(*LAYER, F.col("idx").alias("node"), "sensor1", "sensor2", *AXES)


def knn_edges(cloud: DataFrame, k: int = K, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Edges (src, dst, dist, rank) to the k nearest other points of the layer, ties by dst.

    Points with a missing or infinite coordinate take no part.
    """
    whole = [F.abs(a) < float("inf") for a in AXES]
    points = keyed(cloud).select(*LAYER, "idx", *[(F.col(a) + 0.0).alias(a) for a in AXES]).filter(
        whole[0] & whole[1] & whole[2]
    )
    leaf_rows = max(leaf_rows, 4 * (k + 1))  # so that both halves of a cell hold k + 1 spots
    spot = [*LAYER, *AXES]
    spots = _spots(points, k)
    if points.groupBy(*LAYER).agg(F.count("*").alias("_n")).filter(F.col("_n") > leaf_rows).isEmpty():
        placed, split = spots.withColumn("cell", F.lit("")), False
    else:
        placed, split = _place(spots, leaf_rows)
    own = _streamed(placed, LEAF, _own_leaves(k), _own_schema(placed))
    if split:
        own = cut(own)
        best = own.select(*spot, "ids", "near")
        # only spots near a border have candidates from more than one leaf
        both = best.unionByName(_other_leaves(placed, own, k), allowMissingColumns=True)
        near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1)
        best = both.groupBy(*spot).agg(F.first("ids", ignorenulls=True).alias("ids"), near.alias("near"))
    else:
        best = own.select(*spot, "ids", "near")
    best = cut(best)
    # a spot that lists all its points gives their edges at once; only the points of others are joined
    asked = best.filter(F.size("ids") <= k + 1).select(*LAYER, F.explode("ids").alias("src"), "near")
    crowded = best.filter(F.size("ids") > k + 1).select(*spot, "near")
    if not crowded.isEmpty():
        more = join_skewed(points.withColumnRenamed("idx", "src"), crowded, spot, ["src"])
        asked = asked.unionByName(more.select(*LAYER, "src", "near"))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("src")), 1, k)
    edges = asked.select(*LAYER, "src", F.posexplode(others).alias("rank", "n"))
    return edges.select(
        *LAYER, "src", F.col("n.id").alias("dst"), F.col("n.dist").alias("dist"), (F.col("rank") + 1).alias("rank")
    )


def edge_index(edges: DataFrame, dedupe: bool = False) -> DataFrame:
    """Every edge in both directions; a mutual pair appears twice unless `dedupe`."""
    ahead = edges.select(*LAYER, "src", "dst")
    back = edges.select(*LAYER, F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = ahead.unionByName(back)
    return both.distinct() if dedupe else both


def graph_summary(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Nodes and edges per layer."""
    n = nodes.groupBy(*LAYER).agg(F.count("*").alias("n_nodes"))
    e = index.groupBy(*LAYER).agg(F.count("*").alias("n_edges"))
    return n.join(e, LAYER, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def _first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], item: str, n: int, name: str
) -> DataFrame:
    """One row per key with the list of its first `n` items.

    The rank filter also runs before the shuffle; the list comes from a window over the same
    partitioning, so there is no second shuffle.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(ordered))
        .filter(F.col("_rank") <= n)
        .withColumn(name, F.collect_list(item).over(ordered.rowsBetween(0, n - 1)))
        .filter(F.col("_rank") == 1)
        .select(*keys, name)
    )


def _spots(points: DataFrame, k: int) -> DataFrame:
    """Distinct positions with their k + 2 smallest ids: k + 1 that may be neighbours, one to tell that there are more."""
    return _first_per_group(points, [*LAYER, *AXES], ["idx"], "idx", k + 2, "ids")


def _place(spots: DataFrame, leaf_rows: int) -> tuple[DataFrame, bool]:
    """Add `cell`, the leaf of each spot; also whether any layer has more than one leaf.

    Cells too large for a task are cut by planes from samples, in rounds; the others whole, many in one stream.
    """
    pending = cut(spots.withColumn("cell", F.lit("")))
    schema = pending.schema.simpleString()[7:-1]
    bound = max(SAMPLE, leaf_rows)
    counts = cut(pending.groupBy(*LEAF).agg(F.count("*").alias("_n")).filter(F.col("_n") > leaf_rows))
    if counts.isEmpty():
        return pending, False
    done: list[DataFrame] = []
    crowded = cut(counts.filter(F.col("_n") > bound))
    while not crowded.isEmpty():
        # crowded cells and their trees are as many as their spots divided by `bound` at most
        marked = join_stored(pending, crowded, LEAF, AXES, "left")
        done.append(marked.filter("_n is null").drop("_n"))
        open_spots = marked.filter("_n is not null")
        rate = F.col("_n").cast("double") * (F.pmod(F.xxhash64(*AXES), F.lit(1 << 31)) / float(1 << 31))
        sample = open_spots.filter(rate < SAMPLE).select(*LEAF, *AXES, "_n")
        types = dict(sample.dtypes)
        tree = ", ".join(f"{c} {types[c]}" for c in LEAF) + ", axis array<int>, plane array<double>, _n long"
        trees = cut(sample.groupBy(*LEAF).applyInArrow(_planes(bound, FAN), tree))
        pending = cut(_dealt(open_spots.drop("_n"), trees, _descend, schema))
        crowded = cut(pending.groupBy(*LEAF).agg(F.count("*").alias("_n")).filter(F.col("_n") > bound))
    whole = pending
    for part in done:
        whole = whole.unionByName(part)
    return cut(_streamed(whole, LEAF, _halved(leaf_rows), schema)), True


def _starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each run of rows that agree in `keys` starts; a null agrees with a null."""
    change = np.zeros(len(rows) - 1, bool)
    for key in keys:
        code = rows[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        change |= code[1:] != code[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def _streamed(rows: DataFrame, keys: Sequence[str], work, schema: str) -> DataFrame:
    """Give `work` tables of whole groups, about `STREAM_ROWS` rows at a time or one larger group, and where each starts."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= STREAM_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(table, keys)
                if len(starts) > 1:  # the last group may go on
                    yield from work(table.slice(0, starts[-1]).combine_chunks(), starts[:-1]).select(names).to_batches()
                    table = table.slice(starts[-1])
                held, count = table.to_batches(), len(table)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, _starts(table, keys)).select(names).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _dealt(rows: DataFrame, cells: DataFrame, work, schema: str) -> DataFrame:
    """Give `work` the rows of many cells, of one cell some `QUERY_ROWS` at a time on average, with the rows of `cells`.

    It gets both tables sorted by cell, and the cell of each row as a number.
    """
    counts = rows.groupBy(*LEAF).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > QUERY_ROWS)
    large = cut(counts.withColumn("_slices", F.ceil(F.col("_rows") / QUERY_ROWS).cast("int")).drop("_rows"))
    group = [*LEAF, "_slice"]
    if large.isEmpty():
        dealt, copies = rows.withColumn("_slice", F.lit(0)), cells.withColumn("_slice", F.lit(0))
    else:
        slices = F.coalesce("_slices", F.lit(1))
        dealt = join_stored(rows, large, LEAF, AXES, "left").withColumn("_slice", F.pmod(F.xxhash64(*AXES), slices).cast("int"))
        copies = join_on(cells, large, LEAF, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    kinds = [F.struct(*[F.col(c) for c in side.columns if c not in LEAF]) for side in (rows, cells)]
    none = [F.lit(None).cast(side.select(kind.alias("v")).schema["v"].dataType) for side, kind in zip((rows, cells), kinds)]
    both = dealt.select(*group, kinds[0].alias("row"), none[1].alias("of_cell")).unionByName(
        copies.select(*group, none[0].alias("row"), kinds[1].alias("of_cell"))
    )

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        sides = []
        for side in ("row", "of_cell"):
            there = np.flatnonzero(table[side].is_valid().to_numpy())
            part = table.take(there)
            fields = pa.Table.from_struct_array(part[side].combine_chunks())
            for c in reversed(LEAF):
                fields = fields.add_column(0, c, part[c])
            sides += [fields, number[there]]
        return work(*sides)

    return _streamed(both, group, run, schema)


def _planes(leaf_rows: int, fan: int):
    """A tree over the sample of one cell: node i has children 2i + 1 and 2i + 2; axis -1 marks a leaf."""

    def run(sample: pa.Table) -> pa.Table:
        at, n = _positions(sample), sample["_n"][0].as_py()
        # half full on average, so that few leaves of a sampled cell have to be split again
        leaves = min(fan, -(-2 * n // leaf_rows)) if n > len(at) else -(-n // leaf_rows)
        depth = max(1, int(np.ceil(np.log2(leaves))))
        axis, plane = np.full((1 << depth) - 1, -1, np.int32), np.zeros((1 << depth) - 1)
        parts = {0: np.arange(len(at))}
        for node in range(len(axis)):
            mine = parts.pop(node, np.zeros(0, np.int64))
            spread = np.ptp(at[mine], axis=0) if len(mine) > 1 else np.zeros(3)
            if spread.max() <= 0:
                continue
            a = int(spread.argmax())
            values = np.sort(at[mine, a])
            cut_at = values[len(values) // 2]
            if cut_at == values[0]:  # more than half at the low end
                cut_at = values[np.searchsorted(values, cut_at, side="right")]
            axis[node], plane[node] = a, cut_at
            low = at[mine, a] < cut_at
            parts[2 * node + 1], parts[2 * node + 2] = mine[low], mine[~low]
        out = sample.select(LEAF).slice(0, 1)
        for name, values in (("axis", pa.array([axis])), ("plane", pa.array([plane])), ("_n", pa.array([n]))):
            out = out.append_column(name, values)
        return out

    return run


def _descend(spots: pa.Table, cell: np.ndarray, trees: pa.Table, tree_cell: np.ndarray) -> pa.Table:
    """Extend the path of each spot by the leaf it falls into."""
    at, place = _positions(spots), dict(zip(tree_cell.tolist(), range(len(trees))))
    leaf = np.zeros(len(spots), np.int64)
    for number, first, stop in _runs(cell):
        axis, plane = (trees[c][place[number]].values.to_numpy() for c in ("axis", "plane"))
        here, node = at[first:stop], np.zeros(stop - first, np.int64)
        inner = np.ones(len(node), bool)
        while inner.any():
            inner &= node < len(axis)
            inner[inner] = axis[node[inner]] >= 0
            parent = node[inner]
            node[inner] = 2 * parent + 1 + (here[inner, axis[parent]] >= plane[parent])
        leaf[first:stop] = node
    return _below(spots, leaf)


def _below(spots: pa.Table, child: np.ndarray) -> pa.Table:
    """Extend the path of each spot by the number of a child, unless that is negative."""
    number = pa.array(child).cast(pa.string())
    path = pc.if_else(pa.array(child >= 0), pc.binary_join_element_wise(spots["cell"], number, ".", ""), spots["cell"])
    return spots.set_column(spots.schema.get_field_index("cell"), "cell", path)


def _runs(number: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, first, stop) of each run of equal numbers."""
    first = np.flatnonzero(np.diff(number, prepend=-1))
    yield from zip(number[first].tolist(), first.tolist(), [*first[1:].tolist(), len(number)])


def _halved(leaf_rows: int):
    """Halve whole cells at medians, all of them at once, until no part holds more than `leaf_rows` spots."""

    def run(spots: pa.Table, starts: np.ndarray) -> pa.Table:
        at, leaf, named = _positions(spots), np.full(len(spots), -1), 0
        size = np.diff(np.append(starts, len(spots)))
        part = np.repeat(np.arange(len(starts)), size)
        rows = np.flatnonzero(size[part] > leaf_rows)
        part = part[rows]
        while len(rows):
            first = np.flatnonzero(np.diff(part, prepend=-1))
            size = np.diff(np.append(first, len(rows)))
            number, here = np.repeat(np.arange(len(first)), size), at[rows]
            with np.errstate(over="ignore"):
                spread = np.maximum.reduceat(here, first) - np.minimum.reduceat(here, first)
            values = here[np.arange(len(rows)), spread.argmax(axis=1)[number]]
            order = np.lexsort((values, number))
            rows, values = rows[order], values[order]
            middle = values[first + size // 2]
            # the middle value itself goes up, unless more than half are at the low end
            high = np.where((middle > values[first])[number], values >= middle[number], values > middle[number])
            part = 2 * number + high
            done = np.bincount(part)[part] <= leaf_rows
            leaf[rows[done]] = named + part[done]
            named += 2 * len(first)
            rows, part = rows[~done], part[~done]
        return _below(spots, leaf)

    return run


def _near_schema(placed: DataFrame, extra: Sequence[str] = ()) -> str:
    types = dict(placed.dtypes)
    fields = [f"{c} {types[c]}" for c in [*LAYER, *AXES, *extra]]
    return ", ".join(fields + ["near array<struct<dist: double, id: bigint>>"])


def _own_schema(placed: DataFrame) -> str:
    return _near_schema(placed, ["cell", "ids"]) + ", reach double"


NEAR = pa.struct([("dist", pa.float64()), ("id", pa.int64())])


def _positions(table: pa.Table) -> np.ndarray:
    return np.column_stack([table[a].to_numpy() for a in AXES])


def _nearest(
    queries: np.ndarray, cell: np.ndarray, radius: np.ndarray, spots: pa.Table, spot_cell: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 nearest ids within `radius` of each query position among the spots of its cell by (dist, id).

    Cells are numbers, in whose order the spots come. Returns the queries in order of the lists, list offsets,
    distances and ids. Queries with leaves of like size are compared together, so that little is padded.
    """
    at, ids = np.ascontiguousarray(_positions(spots).T), spots["ids"].combine_chunks()
    counts, flat = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
    first = np.cumsum(counts) - counts
    cells = max(cell.max(initial=-1), spot_cell.max(initial=-1)) + 1
    sizes = np.bincount(spot_cell, minlength=cells)
    begins = np.cumsum(sizes) - sizes
    size, begin = sizes[cell], begins[cell]
    asked = np.argsort(-size, kind="stable")
    lengths, dists, found = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    done = 0
    while done < len(asked) and size[asked[done]]:
        width = size[asked[done]]
        some = asked[done : done + max(1, CELLS // width)]
        done += len(some)
        inside = np.arange(width) < size[some, None]
        near = np.minimum(begin[some, None] + np.arange(width), at.shape[1] - 1)
        dist = np.zeros(near.shape)
        for axis in range(3):
            gap = queries[some, axis, None] - at[axis][near]
            dist += gap * gap
        np.sqrt(dist, out=dist)
        dist[~inside] = np.inf
        limit = radius[some]
        if width > k:
            limit = np.minimum(limit, np.partition(dist, k, axis=1)[:, k])
        row, col = np.nonzero((dist <= limit[:, None]) & inside)
        spot = near[row, col]
        times = counts[spot]
        row, reach = np.repeat(row, times), np.repeat(dist[row, col], times)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        who = flat[np.repeat(first[spot], times) + inner]
        order = np.lexsort((who, reach, row))
        row, reach, who = row[order], reach[order], who[order]
        chosen = np.arange(len(row)) - np.searchsorted(row, row) <= k
        lengths.append(np.bincount(row[chosen], minlength=len(some)))
        dists.append(reach[chosen])
        found.append(who[chosen])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    return asked[:done], offsets, np.concatenate(dists), np.concatenate(found)


def _with_near(
    table: pa.Table, offsets: np.ndarray, dist: np.ndarray, who: np.ndarray, extra: Sequence[str] = ()
) -> pa.Table:
    items = pa.StructArray.from_arrays([pa.array(dist), pa.array(who)], fields=list(NEAR))
    near = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
    return table.select([*LAYER, *AXES, *extra]).append_column("near", near)


def _own_leaves(k: int):
    def run(leaves: pa.Table, starts: np.ndarray) -> pa.Table:
        leaf = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(leaves))))
        asked, offsets, dist, who = _nearest(_positions(leaves), leaf, np.full(len(leaves), np.inf), leaves, leaf, k)
        leaves = leaves.take(asked)
        full = np.diff(offsets) > k
        reach = np.where(full, dist[np.minimum(offsets[:-1] + k, len(dist) - 1)], np.nan)
        ids = leaves["ids"].cast(pa.list_(pa.field("element", pa.int64())))
        leaves = leaves.set_column(leaves.schema.get_field_index("ids"), "ids", ids)
        return _with_near(leaves, offsets, dist, who, ["cell", "ids"]).append_column("reach", pa.array(reach, from_pandas=True))

    return run


def _boxes(placed: DataFrame) -> DataFrame:
    """Bounding box of every cell of the trees but the roots: `cell` is its parent, `child` its own path."""
    leaves = cut(
        placed.groupBy(*LEAF).agg(*[end(a).alias(f"{a}{i}") for a in AXES for i, end in enumerate((F.min, F.max))])
    )
    steps = F.split(F.regexp_replace("cell", r"\.$", ""), r"\.")
    around = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.array_join(F.slice(steps, F.lit(1), n), "."), F.lit("."))
    )
    return (
        leaves.filter("cell <> ''")
        .withColumn("child", F.explode(around))
        .withColumn("leaf", F.col("child") == F.col("cell"))
        .groupBy(*LAYER, "child")
        .agg(F.max("leaf").alias("leaf"), *[end(f"{a}{i}").alias(f"{a}{i}") for a in AXES for i, end in enumerate((F.min, F.max))])
        .withColumn("cell", F.regexp_replace("child", r"[0-9]+\.$", ""))
    )


def _other_leaves(placed: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """Neighbours from the other leaves whose box a spot's ball touches, found level by level of the trees."""
    boxes = cut(_boxes(placed))
    radius = F.when(F.col("reach").isNotNull(), F.col("reach") * (1 + SLACK)).otherwise(F.lit(float("inf")))
    split = boxes.select(*LAYER).distinct()
    asked = own.select(*LAYER, *AXES, F.col("cell").alias("home"), radius.alias("radius")).join(split, LAYER)
    asked = cut(asked.withColumn("cell", F.lit("")))
    types = dict(asked.dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in asked.columns) + ", leaf boolean"
    found: list[DataFrame] = []
    while not asked.isEmpty():
        touched = cut(_dealt(asked, boxes, _touching, fields))
        found.append(touched.filter("leaf").select(*LEAF, *AXES, "radius"))
        asked = touched.filter("not leaf").drop("leaf")
    queries = found[0]
    for part in found[1:]:
        queries = queries.unionByName(part)
    return _dealt(queries, placed.select(*LEAF, *AXES, "ids"), _other_leaf(k), _near_schema(placed))


def _touching(spots: pa.Table, cell: np.ndarray, boxes: pa.Table, box_cell: np.ndarray) -> pa.Table:
    """Each spot once per child whose box its ball touches, the spot's own leaf left out."""
    at, reach = _positions(spots), spots["radius"].to_numpy()
    low = np.column_stack([boxes[f"{a}0"].to_numpy() for a in AXES])
    high = np.column_stack([boxes[f"{a}1"].to_numpy() for a in AXES])
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    between = {number: (first, stop) for number, first, stop in _runs(box_cell)}
    for number, first, stop in _runs(cell):
        left, right = between.get(number, (0, 0))
        step = max(1, CELLS // max(1, right - left))
        for begin in range(first, stop, step):
            end = min(begin + step, stop)
            gap = np.zeros((end - begin, right - left))
            for i in range(3):
                here = at[begin:end, i, None]
                gap += np.maximum(0.0, np.maximum(low[None, left:right, i] - here, here - high[None, left:right, i])) ** 2
            row, box = np.nonzero(np.sqrt(gap) <= reach[begin:end, None])
            rows.append(row + begin), cells.append(box + left)
    row, box = np.concatenate(rows), np.concatenate(cells)
    out = spots.take(row)
    out = out.set_column(out.schema.get_field_index("cell"), "cell", boxes["child"].take(box)).append_column("leaf", boxes["leaf"].take(box))
    return out.filter(pc.not_equal(out["cell"], out["home"]))


def _other_leaf(k: int):
    def run(queries: pa.Table, cell: np.ndarray, spots: pa.Table, spot_cell: np.ndarray) -> pa.Table:
        asked, offsets, dist, who = _nearest(_positions(queries), cell, queries["radius"].to_numpy(), spots, spot_cell, k)
        out = _with_near(queries.take(asked), offsets, dist, who)
        return out.filter(pa.array(np.diff(offsets) > 0))

    return run
