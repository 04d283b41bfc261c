from pyspark.sql import functions as F

from weftline.runtime import blank, checkpoint, small, spread_join


def test_spread_join_with_hot_plain_and_missing_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(300)] + [("none", 1), (None, 2)], "k string, v int")
    lookup = rows.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.concat(F.lit("x"), "k"))
    inner = spread_join(rows, lookup, "k", "n", rows.count())
    assert inner.columns == ["k", "v", "x"] and inner.count() == 1200
    left = spread_join(rows, lookup, "k", "n", rows.count(), "left")
    assert left.count() == 1202 and left.where("x IS NULL").count() == 2
    assert spread_join(rows, lookup.limit(0), "k", "n", 10).count() == 0


def test_checkpoint_cuts_the_plan(spark):
    df = checkpoint(spark.range(10).withColumn("x", F.col("id") + 1))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()


def test_small_and_blank(spark):
    assert "BroadcastHashJoin" in spark.range(1000).join(small(spark.range(5)), "id")._jdf.queryExecution().toString()
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("\t\u00a0",), ("a",)], "s string")
    assert [r[0] for r in df.select(blank(F.col("s"))).collect()] == [True, True, True, True, False]
