import random

from pyspark.sql import functions as F

from hydroseries.operators.rowindex import row_index


def test_positions_equal_a_plain_sort(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(6) if r.random() < 0.9 else None, i) for i in range(500)]
    rows += [("b", 3, 7)] * 200
    df = spark.createDataFrame(rows, "k string, v int, x long").repartition(7)
    got = sorted(row_index(df, ["k", "v", "x"]).collect(), key=lambda r: r["row_index"])
    assert [g["row_index"] for g in got] == list(range(len(rows)))
    none = lambda v: (v is not None, v if v is not None else 0)
    plain = sorted(rows, key=lambda t: (t[0] is not None, t[0] or "", none(t[1]), t[2]))
    assert [(g["k"], g["v"], g["x"]) for g in got] == plain
    assert row_index(df.limit(0), ["k"]).count() == 0


def test_equal_rows_spread_over_partitions(spark):
    df = spark.range(0, 20_000, 1, 8).selectExpr("1 AS k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = row_index(df, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.selectExpr("count(DISTINCT row_index)", "max(row_index)").first() == (20_000, 19_999)
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 10_000
