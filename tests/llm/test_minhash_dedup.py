import numpy as np
import pytest

from llm_data import awkward, brute_components, empty, shingles
from poolsight.llm import minhash_dedup, words
from poolsight.llm.components import connected


@pytest.mark.parametrize("width", [2, 5])
def test_equals_every_pair_compared(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, width).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], width)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = minhash_dedup.near_duplicates(docs, 5).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: (r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert [got[i] for i in (1, 2, 3)] == [(1, True), (1, False), (1, False)]
    assert [got[i] for i in (7, 8, 9)] == [(7, True), (8, True), (9, True)]
    assert got[10] == (10, True) and got[11] == (10, False)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_tiles_change_nothing(spark):
    """A group of near copies, most pairs of which lie around the threshold, in one task and in many."""
    draw = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(80):
        text = list(base)
        for at in draw.integers(0, 150, int(draw.integers(0, 22))):
            text[at] = f"x{draw.integers(1000)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2)
    for tile in (1 << 21, 1500):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, 2, tile_shingles=tile).collect()}
        assert got == want


@pytest.mark.parametrize("text", ["", "  ", "a", "A b", "x\x1cy é É", "a " * 500 + "b c", "w" * 3_000_000 + " end of it"])
def test_shingle_sets(text):
    data = np.frombuffer(text.encode(), np.uint8)
    for width in (1, 2, 5):
        assert len(words.shingle_set(data, width)) == len(shingles(text, width))
    same = np.frombuffer(text.replace("A", "a").replace(" ", "\t \n").encode(), np.uint8)
    assert (words.shingle_set(data, 2) == words.shingle_set(same, 2)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102), (7, 7), (None, 3), (102, 100)]
    got = dict(connected(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
