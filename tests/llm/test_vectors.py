import math
from fractions import Fraction

import numpy as np
import pyarrow as pa

from poolsight.llm import cap_filters, maxscore

ROWS = [
    (1, [1.0, 0.0, 0.5, -2.0], 0),
    (2, [1.0, 0.0, 0.5, -2.0], 0),
    (3, [2.0, 0.0, 1.0, -4.0], 0),
    (3, [2.0, 0.0, 1.0, -4.0], 0),
    (4, [1.01, 0.0, 0.5, -2.0], 1),
    (5, [0.0, 1.0, 0.0, 0.0], 1),
    (6, [0.0, 0.0, 0.0, 0.0], 1),
    (7, None, 1),
    (8, [1.0, None, 0.0, 0.0], None),
    (9, [float("nan"), 1.0, 0.0, 0.0], None),
    (10, [float("inf"), 1.0, 0.0, 0.0], None),
    (None, [1.0, 0.0, 0.5, -2.0], None),
    (11, [1e-30, 0.0, 5e-31, -2e-30], None),
    (12, [], None),
    (13, [0.0, 1.0], None),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, node long, copies string")


def test_links_of_awkward_rows(spark):
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_filters.near_vectors(table(spark)).collect() if r.vec_id is not None)
    near = {1: 5, 2: 5, 3: 5, 4: 5, 11: 5}
    for vec_id, n_links, component, kept in got:
        if vec_id in near:
            assert (n_links, component, kept) == (5, 1, vec_id == 1)
        elif vec_id in (5, 13):
            assert (n_links, component, kept) == (1, 5, vec_id == 5)
        else:
            assert (n_links, component, kept) == (0, vec_id, True)
    assert len(got) == len(ROWS) - 1
    assert cap_filters.near_vectors(table(spark, [])).count() == 0


def brute_links(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


def test_recall_at_the_threshold(spark):
    """Pairs just above 0.95, the hardest to find, among unrelated vectors."""
    draw = np.random.default_rng(1)
    a = draw.standard_normal((1500, 64))
    b = draw.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.953
    x = np.concatenate((a, c * a + math.sqrt(1 - c * c) * b))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in cap_filters.near_vectors(rows).collect()}
    want = brute_links(x).sum(axis=1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.98 * want.sum()


def test_large_group_in_tiles(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate((draw.standard_normal(64) + 0.15 * draw.standard_normal((150, 64)), draw.standard_normal((50, 64))))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_links(x).sum(axis=1)
    one, tiled = (
        {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(rows, tile_rows=t).collect()} for t in (1024, 40)
    )
    assert one == tiled
    assert sum(n for n, _ in one.values()) >= 0.98 * want.sum()


def test_filters_are_those_above_the_threshold():
    draw = np.random.default_rng(4)
    x = draw.standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, left, right, t = cap_filters.filters(10, 50, 16, 0)
    for v, found in zip(x @ rotation, cap_filters.decode(x, 50, 16, 1)):
        both = (left @ v[:5])[:, None] + (right @ v[5:])[None, :]
        assert found.tolist() == np.flatnonzero(both.ravel() >= t).tolist()


def brute_top(rows, k=5):
    def number(c):
        return max(-(1 << 63), min(math.floor(Fraction(c) * 256), (1 << 63) - 1))

    def score(a, b):
        return max(1 - (1 << 63), min(sum(x * y for x, y in zip(a, b)), (1 << 63) - 1))

    whole = [(i, tuple(map(number, v))) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, v + (0,) * (max(map(len, (w for _, w in whole))) - len(v))) for i, v in whole]
    out = []
    for at, (q, a) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-score(a, b), i) for j, (i, b) in enumerate(whole) if j != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    draw = np.random.default_rng(5)
    for n, shard, spread in ((400, 64, 0.3), (400, 4096, 1e-2), (4, 2, 0.3), (1, 4, 0.3), (300, 50, 1e6), (120, 30, 1e300)):
        rows = [(i, (draw.standard_normal(16) * spread).tolist()) for i in range(n)]
        frame = maxscore.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got = maxscore.top_k(frame.filter("vec_id % 50 = 0"), frame, shard_rows=shard, block_queries=3, group_queries=5).collect()
        assert sorted(map(tuple, got)) == brute_top(rows)


def test_top_k_of_awkward_rows(spark):
    rows = [(i if i != 1 else 50, v) for i, v, _ in ROWS] + [(100, [-1.0, -1.0, -1.0, -1.0])]
    frame = maxscore.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, maxscore.top_k(frame.filter("vec_id % 50 = 0"), frame).collect()))
    assert got == brute_top(rows)
    none = maxscore.whole_numbers(table(spark, []))
    assert maxscore.top_k(none, none).count() == 0


def test_top_k_of_repeated_and_similar_rows(spark):
    draw = np.random.default_rng(6)
    centers = draw.standard_normal((6, 12))
    rows = [(i, (centers[i % 6] + 0.05 * draw.standard_normal(12)).tolist()) for i in range(300)]
    rows += rows[:60] + rows[:1] * 8 + [(50, [1.0]), (100, []), (100, [-1.0] * 12)]
    frame = maxscore.whole_numbers(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row int, score int"))
    got = maxscore.top_k(frame.filter("vec_id % 50 = 0"), frame, shard_rows=40)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_cells_without_a_chance_are_dropped():
    queries = np.eye(3) * 100
    look = maxscore._look(np.arange(10, 13), np.eye(3) * 90, [([90.0, 5, 5], [80.0, -5, -5]), ([5.0, 90, 5], [-5.0, 0, 0])], 1, 3, np.float64)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([1, 2, 3]), pa.array(queries.astype(int).tolist())], ["row", "vec_id", "vector"])
    (found,) = look([batch])
    assert found.column("cells").to_pylist() == [[0], [1], []]
    assert found.column("floor").to_pylist() == ["9000"] * 3
