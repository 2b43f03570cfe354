import random

from pyspark.sql import functions as F

from poolsight.operators import ordered


def test_neighbours_cross_block_borders(spark):
    rows = [("a", i, 10 * i) for i in range(3, 15)] + [("b", i, i) for i in range(2)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for block_rows in (2, 3, 5, 100):
        got = ordered.with_neighbours(df, ["k"], "i", "v", block_rows).collect()
        assert len(got) == len(rows)
        values = {(r.k, r.i): r.v for r in got}
        for r in got:
            assert r.prev_v == values.get((r.k, r.i - 1))
            assert r.next_v == values.get((r.k, r.i + 1))


def test_next_marked_carries_over_empty_blocks(spark):
    marks = {4, 5, 17, 30}
    rows = [("a", i, i in marks) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i long, m boolean").withColumn("blk", F.expr("i div 4"))
    got = ordered.next_marked(df, ["k"], "i", F.when(F.col("m"), F.col("i")), "nxt").collect()
    for r in got:
        assert r.nxt == min((m for m in marks if m > r.i), default=None)


def test_row_index_and_running_sum(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(100)) for k in "ab" for i in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = ordered.with_row_index(df, ["k"], "i", block_rows=50).collect()
    for k in "ab":
        mine = sorted((r.i, r.row_nr) for r in got if r.k == k)
        assert [n for _, n in mine] == list(range(60))
    blocked = ordered.range_blocks(df, ["k"], ["i"])
    summed = ordered.running_sum(blocked, ["k"], "i", F.col("v"), "s", "blk").collect()
    for k in "ab":
        total = 0
        for r in sorted((r for r in summed if r.k == k), key=lambda r: r.i):
            total += r.v
            assert r.s == total
