import numpy as np
import pyarrow as pa
import pytest

from poolsight.operators import graph


def points_frame(spark, positions, layer=30, start=0):
    rows = [
        ("s", "c", "j", None, layer, start + i, 1.0, 2.0, *[None if v is None else float(v) for v in p])
        for i, p in enumerate(positions)
    ]
    return spark.createDataFrame(
        rows,
        "session string, config string, job string, subfolder int, layer int, idx long, sensor1 double, sensor2 double, x double, y double, z double",
    )


def brute(positions, k):
    p = np.array(positions, dtype=float)
    out = set()
    for i in range(len(p)):
        d = np.sqrt(((p - p[i]) ** 2).sum(axis=1))
        order = sorted((d[j], j) for j in range(len(p)) if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(order)}
    return out


def edges_of(df, k, leaf_rows):
    return {(r.src, r.dst, r["rank"]) for r in graph.knn_edges(df, k, leaf_rows).collect()}


def test_golden(spark):
    df = points_frame(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (10, 0, 0)])
    edges = graph.knn_edges(df, 2)
    got = sorted((r.src, r["rank"], r.dst) for r in edges.collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1)]
    index = graph.edge_index(edges)
    assert index.count() == 16
    assert graph.edge_index(edges, dedupe=True).count() < 16
    summary = graph.graph_summary(graph.node_features(df), index).first()
    assert (summary.n_nodes, summary.n_edges) == (4, 16)


def shapes():
    rng = np.random.default_rng(11)
    uniform = rng.random((120, 3)) * [10, 10, 0]
    dense = np.concatenate([rng.normal(scale=1e-3, size=(90, 3)), rng.random((30, 3)) * 100])
    copies = np.concatenate([np.zeros((40, 3)), rng.integers(0, 3, (60, 3))])
    line = np.stack([np.arange(80) ** 2.0, np.zeros(80), np.zeros(80)], axis=1)
    few = rng.random((4, 3))
    outlier = np.concatenate([rng.normal(scale=1e-9, size=(150, 3)), rng.random((20, 3)), [[1e15, -1e15, 3.0], [1e300, 0, 0]]])
    return {"outlier": outlier, "uniform": uniform, "dense": dense, "copies": copies, "line": line, "few": few}


@pytest.mark.parametrize("name", list(shapes()))
def test_against_all_pairs(spark, name):
    positions = shapes()[name]
    df = points_frame(spark, positions)
    for leaf_rows in (4, 1024):
        assert edges_of(df, 5, leaf_rows) == brute(positions, 5)


def test_layers_do_not_mix_and_gaps_are_left_out(spark):
    a = points_frame(spark, [(0, 0, 0), (1, 0, 0), (None, 0, 0)])
    b = points_frame(spark, [(0.1, 0, 0), (5, 0, 0)], layer=60, start=100)
    assert edges_of(a.unionByName(b), 3, 2) == {(0, 1, 1), (1, 0, 1), (100, 101, 1), (101, 100, 1)}


def test_trees_from_samples_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "SAMPLE", 60)
    monkeypatch.setattr(graph, "FAN", 4)
    monkeypatch.setattr(graph, "QUERY_ROWS", 50)
    rng = np.random.default_rng(3)
    positions = np.concatenate([rng.normal(scale=1e-6, size=(300, 3)), rng.random((200, 3)) * [50, 3, 0], np.ones((30, 3))])
    assert edges_of(points_frame(spark, positions), 5, 4) == brute(positions, 5)
    placed, split = graph._place(graph._spots(graph.keyed(points_frame(spark, positions)), 5), 24)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert split and max(sizes) <= 24 and sum(sizes) == 501


def test_many_leaves_in_one_call():
    rng = np.random.default_rng(9)
    sizes = [1, 40, 3, 6, 7, 25]
    cell = np.repeat(np.arange(len(sizes)), sizes)
    at = rng.integers(0, 6, (len(cell), 3)).astype(float)
    spots = pa.table({**dict(zip("xyz", at.T)), "ids": [[2 * i, 2 * i + 1] for i in range(len(cell))], "cell": [""] * len(cell)})
    radius = np.where(np.arange(len(cell)) % 3 == 0, 2.5, np.inf)
    asked, offsets, dist, who = graph._nearest(at, cell, radius, spots, cell, 4)
    assert sorted(asked.tolist()) == list(range(len(cell)))
    for q, first, stop in zip(asked, offsets, offsets[1:]):
        gap = np.sqrt(((at - at[q]) ** 2).sum(axis=1))
        near = sorted((gap[j], i) for j in np.flatnonzero((cell == cell[q]) & (gap <= radius[q])) for i in (2 * j, 2 * j + 1))[:5]
        assert list(zip(dist[first:stop], who[first:stop])) == near
    at = np.unique(at, axis=0)
    spots = pa.table({**dict(zip("xyz", at.T)), "cell": ["3."] * len(at)})
    starts = np.array([0, 5, 6])
    cells = graph._halved(5)(spots, starts)["cell"].to_pylist()
    assert set(cells[:6]) == {"3."} and max(map(cells[6:].count, cells[6:])) <= 5 and all(c.startswith("3.") for c in cells)


def test_nulls_agree_in_runs():
    rows = pa.table({"a": ["u", "u", None, None, "v"], "b": [None, None, 1, 1, 1]})
    assert graph._starts(rows, ["a", "b"]).tolist() == [0, 2, 4]
