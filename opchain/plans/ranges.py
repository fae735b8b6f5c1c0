"""Running totals and dense numbers over a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opchain.plans.scratch import Scratch


def running_total(df: DataFrame, order: list[str], value: str, name: str, scratch: Scratch) -> DataFrame:
    """df with the sum of `value` over all rows before each one.  Rows are sorted in ranges; one total a range goes through a single task."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = scratch.keep(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    base = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return local.join(F.broadcast(base), "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")


def dense_ids(df: DataFrame, columns: list[str], name: str, scratch: Scratch) -> DataFrame:
    """The different values of some columns, numbered from 1 in their order."""
    keys = df.select(*columns).distinct().withColumn("_one", F.lit(1))
    return running_total(keys, columns, "_one", name, scratch).withColumn(name, (F.col(name) + 1).cast("long")).drop("_one")
