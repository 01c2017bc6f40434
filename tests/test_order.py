"""Numbers over whole tables are those of one window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.order import running


def test_running_numbers_and_sums(spark):
    rows = [(i * 7919 % 1009 if i % 11 else None, i, i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, id long, size long")
    order = [F.col("a").desc_nulls_last(), F.col("id").asc()]
    w = Window.orderBy(*order)
    want = df.withColumn("rank", F.row_number().over(w)).withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    got = running(df, order, F.col("size"))
    assert sorted(map(tuple, got.select("id", "rank", "before").collect())) == sorted(map(tuple, want.select("id", "rank", "before").collect()))
    assert got.columns == [*df.columns, "rank", "before"]
    assert running(df.limit(0), order).count() == 0
