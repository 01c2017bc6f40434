"""Numbers and running sums over whole tables, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running(df: DataFrame, order: list[Column], add: Column | None = None, label: str = "running", keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """df with rank, its number from 1 in this order, and with before, the sum of ``add`` over all rows before it.

    Rows are dealt to ranges of the order and are written with the number of their range, by keep(df, label); the counts
    and sums of all ranges, one row each, give what is added to the numbers within a range. So a task sees one range, at
    any rank. The order has to end in a column that tells rows apart: equal rows are one range. Null counts as it sorts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(0) if add is None else add
    dealt = keep(df.withColumn("__add", value.cast("long")).repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), label)
    ranges = dealt.groupBy("__range").agg(F.count("*").alias("__n"), F.sum("__add").alias("__s"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``parts`` rows
    ranges = ranges.select("__range", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(y) for x, y in (("__n", "__n0"), ("__s", "__s0"))])
    within = Window.partitionBy("__range").orderBy(*order)
    out = dealt.join(F.broadcast(ranges), "__range")
    out = out.withColumn("rank", F.row_number().over(within) + F.col("__n0"))
    if add is not None:
        out = out.withColumn("before", F.sum("__add").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__add") + F.col("__s0"))
    return out.drop("__range", "__add", "__n0", "__s0")
