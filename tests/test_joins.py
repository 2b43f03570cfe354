from pyspark.sql import functions as F

from poolsight.operators.joins import broadcast_limit, join_skewed, join_summary


def test_summary_join_is_the_same_both_ways(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10).alias("k"))
    summary = rows.filter("k <> 5").groupBy("k").agg(F.sum("id").alias("total"))
    want = {(r.id, r.k, r.total) for r in rows.join(summary, "k").collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert broadcast_limit(rows) == (10 << 20 if limit == "10MB" else -1)
            joined = join_summary(rows, summary, ["k"], ["id"], salts=7)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (limit == "10MB")
            assert {(r.id, r.k, r.total) for r in joined.collect()} == want
            assert join_summary(rows, summary, ["k"], ["id"], "left", 7).filter("total is null").count() == rows.filter("k = 5").count()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"))
    other = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = {(r.id, r.k, r.v) for r in rows.join(other, "k").collect()}
    for hot_rows in (50, 1 << 20):
        joined = join_skewed(rows, other, ["k"], ["id"], hot_rows)
        assert joined.count() == len(want)
        assert {(r.id, r.k, r.v) for r in joined.collect()} == want
