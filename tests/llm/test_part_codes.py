import math
from fractions import Fraction

import numpy as np
import pytest

from poolsight.llm import metric_trees, part_codes
from poolsight.llm.queries import QUERIES

WIDE = "vec_id long, embedding array<double>, label int, code string, node long"


@pytest.mark.parametrize("seed", range(30))
def test_trees_find_the_nearest_entries(seed):
    draw = np.random.default_rng(seed)
    n, width, top = [(1, 1, 1), (2, 3, 2), (60, 2, 3), (400, 4, 1), (900, 16, 500), (700, 8, 20)][seed % 6]
    points = draw.integers(-top, top + 1, (n, width)).astype(float)
    if seed % 4 == 0:
        points[: n // 2] = points[0]
    if seed % 5 == 0:  # tight groups far apart: whole balls are owned
        points += 10000 * draw.integers(0, 4, (n, 1))
    entries = np.concatenate((points[draw.integers(0, n, 40)], draw.integers(-top, top + 1, (20, width)).astype(float)))
    tree = metric_trees.build(points, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(n))
    placed = points[tree.order]
    for a, b, s, r in zip(tree.start, tree.stop, tree.sums, tree.radius):
        assert (placed[a:b].sum(axis=0) == s).all()
        assert (np.linalg.norm(placed[a:b] - s / (b - a), axis=1) <= r + 1e-9).all()
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (metric_trees.nearest(tree, placed, entries) == want).all()
    sums, counts = metric_trees.totals(tree, placed, entries)
    assert (counts == np.bincount(want, minlength=len(entries))).all()
    for e in range(len(entries)):
        assert (sums[e] == points[want == e].sum(axis=0)).all()
    if seed % 5 == 0 and n > 300:
        assert len(metric_trees.assign(tree, placed, entries).places) < n


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector) without the unusable ones, in the order of the first codebook."""
    width = max(1, -(-max((len(v) for _, v in rows), default=0) // parts)) * parts
    whole = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (width - len(v)) for _, v in rows]
    cut = [[v[p * width // parts : (p + 1) * width // parts] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owned = [near(v[p], books[p])[1] for v in cut]
            books[p] = [
                [sum(c) // len(mine) for c in zip(*mine)] if (mine := [v[p] for v, o in zip(cut, owned) if o == i]) else e
                for i, e in enumerate(books[p])
            ]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{i:02x}" for _, i in f), min(sum(d for d, _ in f), part_codes.LONGEST)) for f in found], books


@pytest.mark.parametrize("big", [1.0, 3e4, 1e300])
def test_codes_match_brute_force(spark, big):
    draw = np.random.default_rng(7)
    rows = [(i, (draw.standard_normal(7) * big).tolist()) for i in range(60 if big > 1e9 else 300)]
    rows += [(i, list(v)) for i, v in rows[:20]]  # repeated rows
    rows += [(500, []), (501, [0.25]), (None, [1.0, -0.0])]
    bad = [(600, None), (601, [1.0, None]), (602, [float("nan")]), (603, [float("-inf"), 1.0])]
    table = spark.createDataFrame([(i, v, None if i == 3 else 1, "c", 9) for i, v in rows + bad], WIDE)
    codes, books = part_codes.compress(table, entries=16)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    want, want_books = brute(ordered, entries=16)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.vec_id, r.code, r.error) for r in codes.collect()), key=key)
    assert got == sorted(((i, c, e) for (i, _), (c, e) in zip(ordered, want)), key=key)
    assert books == want_books
    total = {r.label: r.label_error for r in part_codes.label_errors(codes).select("label", "label_error").distinct().collect()}
    assert set(total) == {1, None}
    assert total[None] == min(sum(e for (i, _), (_, e) in zip(ordered, want) if i == 3), part_codes.LONGEST)


def test_empty_and_unusable_tables(spark):
    codes, books = part_codes.compress(spark.createDataFrame([], WIDE))
    assert codes.count() == 0 and books == [[], [], [], []]
    codes, _ = part_codes.compress(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert part_codes.label_errors(codes).count() == 0
    codes, books = part_codes.compress(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>"))
    assert [(r.code, r.error) for r in codes.collect()] == [("00000000", 0)] and books == [[[0]]] * 4
    with pytest.raises(ValueError):
        part_codes.compress(spark.createDataFrame([], WIDE), entries=257)


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op11_part_codes"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_a_round_takes_one_job_whatever_the_partitions(spark):
    draw = np.random.default_rng(5)
    table = spark.createDataFrame([(i, draw.standard_normal(8).tolist(), 1, "c", 9) for i in range(200)], WIDE)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("part codes", "rounds")
        codes, _ = part_codes.compress(table, entries=16)
        jobs = len(context.statusTracker().getJobIdsForGroup("part codes"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert codes.count() == 200
    assert jobs < 64
