import numpy as np
import pytest

from poolsight.operators import features, segments, signal_blocks


def naive_segments(grouping, state):
    before, inside = (int(c) for c in grouping.split("-"))
    n, starts, ends = len(state), [], []
    known = lambda i: 0 <= i < n and state[i] is not None
    for i, c in enumerate(state):
        if before != inside:
            starts += [i] * (known(i - 1) and state[i - 1] == before and c == inside)
            ends += [i] * (known(i - 1) and state[i - 1] == inside and c == before)
        else:
            starts += [i] * (known(i - 1) and state[i - 1] != inside and c == inside)
            ends += [i] * (known(i + 1) and state[i + 1] != inside and c == inside)
    return [(s, min(e for e in ends if e > s)) for s in starts if any(e > s for e in ends)]


@pytest.mark.parametrize("grouping", segments.GROUPINGS)
@pytest.mark.parametrize("seed", range(5))
def test_pieces_of_blocks_cover_each_segment_once(grouping, seed):
    draw = np.random.default_rng(seed)
    state = [None if x == 9 else int(x) for x in np.repeat(draw.choice([0, 1, 1, 0, 2, 9], 60), draw.integers(1, 9, 60))]
    wanted = naive_segments(grouping, state)
    block, n, covered, closing, heads, open_starts = 12, len(state), {}, {}, {}, []
    for b in range(-(-n // block)):
        low, high = b * block, (b + 1) * block
        idx = np.arange(max(low - 1, 0), min(high + features.LAGS + 1, n))
        values = np.array([np.nan if state[i] is None else state[i] for i in idx], float)
        for kind, first, stop, _ in zip(*signal_blocks.pieces(idx, *signal_blocks.flags(grouping, values, idx), low, high, 1)):
            if kind == signal_blocks.WHOLE:
                covered[int(first)] = int(stop)
            elif kind == signal_blocks.TAIL:
                open_starts.append((int(first), b))
            else:
                heads[b] = int(stop)
    for first, b in open_starts:
        following = [heads[c] for c in sorted(heads) if c > b and heads[c] >= 0]
        if following:
            covered[first] = following[0]
    assert sorted(covered.items()) == wanted


@pytest.mark.parametrize(("grouping", "block_rows"), [("0-1", 16), ("0-0", 11), ("1-1", 1 << 18)])
def test_same_table_as_from_segment_rows(cloud, grouping, block_rows):
    draw = np.random.default_rng(4)
    tables = []
    for layer, n in ((30, 300), (60, 45), (90, 5)):
        state = np.repeat(draw.integers(0, 2, n), draw.integers(1, 14, n))[:n].tolist()
        positive, mixed = (draw.random(n) + 5).tolist(), draw.standard_normal(n).tolist()
        if layer == 60:
            positive[20], mixed[3] = float("nan"), None
        tables.append(cloud(state, layer, sensor0=positive, sensor1=mixed))
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2])
    index = segments.segment_index(rows, grouping, min_length=1)
    key = features.SIGNAL
    want = features.feature_table(segments.segment_rows(rows, index)).toPandas().sort_values(key, ignore_index=True)
    got = signal_blocks.segment_features(rows, grouping, min_length=1, block_rows=block_rows).toPandas().sort_values(key, ignore_index=True)
    assert len(want) >= 8 and list(got.columns) == list(want.columns)
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert np.allclose(want[c], got[c], rtol=1e-8, atol=1e-8, equal_nan=True), c
        else:
            assert (want[c].eq(got[c]) | (want[c].isna() & got[c].isna())).all(), c


def test_one_scan_and_one_exchange(cloud):
    plan = signal_blocks.block_moments(cloud([0, 1, 0] * 9, sensor0=[1.0] * 27, sensor1=[1.0] * 27))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_arguments(cloud):
    rows = cloud([0, 1, 0], sensor0=[1.0] * 3, sensor1=[1.0] * 3)
    with pytest.raises(ValueError):
        signal_blocks.block_moments(rows, "2-1")
    with pytest.raises(ValueError):
        signal_blocks.block_moments(rows, block_rows=10)
    with pytest.raises(KeyError):
        signal_blocks.block_moments(rows, state="state9")
    assert signal_blocks.segment_features(rows.limit(0)).count() == 0
