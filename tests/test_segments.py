import random

import pytest

from poolsight.operators import segments

GOLDEN_STATES = [1, 1, 0, 0, 0, 1, 1, 1, 0, 1, 0, 0, 1, 1]
GOLDEN = {
    "0-1": [(5, 8), (9, 10)],
    "1-0": [(2, 5), (8, 9), (10, 12)],
    "0-0": [(2, 4), (8, 11), (10, 11)],
    "1-1": [(5, 7)],
}


def brute(states, grouping, min_length):
    """Pairs by a plain scan; a comparison with None is never true."""
    a, b = (int(x) for x in grouping.split("-"))
    n = len(states)
    at = lambda i: states[i] if 0 <= i < n else None
    is_ = lambda v, x: v is not None and v == x
    not_ = lambda v, x: v is not None and v != x
    starts, ends = [], []
    for i in range(n):
        if a != b:
            start, end = is_(at(i - 1), a) and is_(at(i), b), is_(at(i - 1), b) and is_(at(i), a)
        else:
            start, end = not_(at(i - 1), a) and is_(at(i), a), is_(at(i), a) and not_(at(i + 1), a)
        starts += [i] * start
        ends += [i] * end
    out = []
    for s in starts:
        later = [e for e in ends if e > s]
        if later and later[0] - s >= min_length:
            out.append((s, later[0]))
    return out


def pairs(index):
    return sorted((r.seg_id, r.seg_end) for r in index.collect())


@pytest.mark.parametrize("grouping", list(GOLDEN))
def test_golden(cloud, grouping):
    df = cloud(GOLDEN_STATES)
    for block_rows in (2, 3, 1000):
        index = segments.segment_index(df, grouping, min_length=1, block_rows=block_rows)
        assert pairs(index) == GOLDEN[grouping]
    assert brute(GOLDEN_STATES, grouping, 1) == GOLDEN[grouping]


@pytest.mark.parametrize("grouping", list(GOLDEN))
def test_random_layers_in_small_blocks(spark, cloud, grouping):
    rng = random.Random(grouping)
    layers, df = {}, None
    for layer in range(12):
        alphabet = [[0, 1], [0, 1, 2], [0, 1, None]][layer % 3]
        states = [rng.choice(alphabet) for _ in range(rng.randrange(60))]
        layers[layer] = states
        if states:
            part = cloud(states, layer=layer, sensor0=[float(i) for i in range(len(states))], sensor1=[0.0] * len(states))
            df = part if df is None else df.unionByName(part)
    index = segments.segment_index(df, grouping, min_length=2, block_rows=7)
    got = sorted((r.layer, r.seg_id, r.seg_end) for r in index.collect())
    want = sorted((layer, s, e) for layer, states in layers.items() for s, e in brute(states, grouping, 2))
    assert got == want
    rows = segments.segment_rows(df, index, piece_rows=4)
    members = sorted((r.layer, r.seg_id, r.pos, r.sensor0) for r in rows.collect())
    assert members == sorted((layer, s, i - s, float(i)) for layer, s, e in want for i in range(s, e))


def test_edges(spark, cloud):
    assert pairs(segments.segment_index(cloud([0] * 20), "0-0", min_length=1)) == []
    assert pairs(segments.segment_index(cloud([1] * 20), "0-1", min_length=1)) == []
    empty = cloud([0]).filter("idx < 0")
    assert pairs(segments.segment_index(empty, "0-1")) == []
    with pytest.raises(ValueError):
        segments.segment_index(cloud([0, 1]), "2-0")
    with pytest.raises(KeyError):
        segments.segment_index(cloud([0, 1]).drop("state0"), "0-1")


def test_min_length_is_ten(cloud):
    states = [0] + [1] * 9 + [0] + [1] * 10 + [0]
    assert pairs(segments.segment_index(cloud(states))) == [(11, 21)]


def test_subfolders_are_separate_layers(spark, cloud):
    a = cloud(GOLDEN_STATES)
    b = a.withColumn("subfolder", a.idx * 0 + 7).withColumn("subfolder", a.layer * 0 + 7)
    index = segments.segment_index(a.unionByName(b), "0-1", min_length=1)
    assert sorted((r.part, r.seg_id) for r in index.collect()) == [(-1, 5), (-1, 9), (7, 5), (7, 9)]
    per_group = segments.segments_per_group(a.unionByName(cloud([0] * 5, layer=60)), index.filter("part = -1"))
    assert sorted((r.layer, r.n_segments) for r in per_group.collect()) == [(30, 2), (60, 0)]


def test_long_segment_arrays_come_in_parts(cloud):
    n = 50
    df = cloud([0] + [1] * n + [0], sensor0=[float(i) for i in range(n + 2)], sensor1=[1.0] * (n + 2))
    rows = segments.segment_rows(df, segments.segment_index(df), piece_rows=8)
    parts = sorted(segments.segment_arrays(rows, part_rows=20).collect(), key=lambda r: r.seg_part)
    assert [len(p.samples) for p in parts] == [20, 20, 10]
    assert [s.sensor0 for p in parts for s in p.samples] == [float(i) for i in range(1, n + 1)]
