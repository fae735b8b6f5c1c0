"""Sums and graphs made from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SITES = 8


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, n, id, q, l_linenumber, l_partkey, l_suppkey) of lineitem: site 1 + suppkey mod 8, operator 2 + partkey mod 3, quantity."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", (F.col("l_suppkey") % N_SITES + 1).cast("int").alias("n"), (F.col("l_partkey") % 3 + 2).cast("int").alias("id"), F.col("l_quantity").cast("bigint").alias("q"), "l_linenumber", "l_partkey", "l_suppkey")


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for each order: on each of its sites the operator of its first line there, times the sum of its quantities."""
    lines = order_lines(spark, sf_dir)
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", "id"))["id"]
    each = lines.groupBy("l_orderkey", "n").agg(first.alias("id"), F.sum("q").alias("q"))
    coeff = F.struct(F.sum("q").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return each.groupBy("l_orderkey").agg(coeff.alias("coeff"), F.array_sort(F.collect_list(F.struct("n", "id"))).alias("ops")).withColumnRenamed("l_orderkey", "term_id")


def raw_order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for each order with its lines as operators in line order, several on a site too."""
    lines = order_lines(spark, sf_dir)
    ops = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", "n", "id"))), lambda x: F.struct(x["n"].alias("n"), x["id"].alias("id")))
    coeff = F.struct(F.sum("q").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return lines.groupBy(F.col("l_orderkey").alias("term_id")).agg(coeff.alias("coeff"), ops.alias("ops"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lv, rv, w): orders and parts of lines with a quantity of 48 or more; the weight is the quantity, negative on odd lines, added up."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 48")
    signed = F.when(F.col("l_linenumber") % 2 == 1, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint")
    return li.select(F.col("l_orderkey").alias("lv"), F.col("l_partkey").alias("rv"), signed.alias("w")).groupBy("lv", "rv").agg(F.sum("w").alias("w"))
