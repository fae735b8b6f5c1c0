"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opchain.plans.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in no more partitions than its rows need; a table of a few rows is not worth hundreds of tasks."""
    return df.coalesce(max(1, -(-rows // each)))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(vertex, component) of every vertex of edges (u, v); a component is named by its least vertex.

    Rows with a null end are ignored, a loop u = u gives a component of one vertex, an empty list
    gives no rows.  No vertex's neighbours meet in one task: every step is a partial minimum and an
    equi-join that adaptive execution can split.  Each step is a written table, so the plan stays
    short and lost executors cost one step.
    """
    u, v = edges.columns[:2]
    scratch = scratch or Scratch(edges.sparkSession, "components")
    plain = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null").distinct()
    given = scratch.keep(plain, "edges")
    now, mark = given.where("u <> v"), None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        if found == mark or not found[0]:
            break
        mark, old = found, now
        now = scratch.keep(_few(_small_star(_large_star(now).distinct()).distinct(), found[0]), "links")
        if hasattr(old, "scratch_path"):
            scratch.drop(old)
    links = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    ends = given.select(F.col("u").alias("vertex")).union(given.select("v")).distinct()
    out = ends.join(links, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
    out = scratch.keep(_few(out, found[0]), "components")
    scratch.drop(given, *([now] if hasattr(now, "scratch_path") else []))
    return out
