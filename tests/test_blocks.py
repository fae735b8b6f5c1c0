"""Block numbers beyond the whole numbers that a double holds, and graphs of many edges as text."""

from pyspark.sql import functions as F

from opchain.operators import graph, tensor
from opchain.sources.catalog import Catalog


def test_block_numbers_above_two_to_53(spark):
    sizes = (10**6 + 3, 10**6 + 1, 999)
    blocks = [(7, 5, 3, 2), (9007, 10**6 + 3, 10**6 + 1, 999), (1, 1, 1, 1), (8123, 44, 10**6, 998)]
    lit = [F.lit(x).cast("long") for x in sizes]
    df = spark.createDataFrame(blocks, "a long, b long, c long, d long").withColumn("k", tensor.block_id(F.col("a"), F.col("b"), F.col("c"), F.col("d"), *lit))
    assert df.agg(F.max("k")).first()[0] > 2**53
    back = df.select("a", "b", "c", "d", *(x.alias(f"x{i}") for i, x in enumerate(tensor.block_of_id(F.col("k"), *lit))))
    assert all(tuple(r)[:4] == tuple(r)[4:] for r in back.collect())


def test_every_edge_is_described(spark):
    catalog = Catalog.uniform("Qubit", 2, ["I", "X", "Y", "Z"], conserve=False)
    edges = spark.range(1, 1502).select(F.col("id").alias("link"), F.lit(2).alias("op_id"), F.lit(False).alias("jw"), F.expr("cast(array() as array<struct<n:int,id:int>>)").alias("suffix"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    assert len(graph.describe(edges, 1, catalog).split("\n")) == 1501
