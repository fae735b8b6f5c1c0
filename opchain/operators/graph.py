"""The bipartite graph at a site or a cut: left parts, right parts, and the weights between them.

An edge row carries its left vertex (link, op_id, jw) or prefix, its right vertex as the suffix of
operators itself, and a weight.  Rows may repeat an edge; their weights add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opchain.functions import terms as X
from opchain.operators.components import connected_components
from opchain.plans.ranges import dense_ids
from opchain.plans.scratch import Scratch
from opchain.sources.catalog import Catalog


def first_graph(unique: DataFrame, catalog: Catalog) -> DataFrame:
    """Edges at site 1 from combined terms (ops, re, im): one incoming link, the operator on site 1, the rest as suffix."""
    ops = F.col("ops")
    return unique.select(F.lit(1).alias("link"), X.onsite_op(ops, 1).cast("int").alias("op_id"), X.is_odd(ops, 2, catalog).alias("jw"), X.from_site(ops, 2).alias("suffix"), "re", "im")


def next_graph(passed: DataFrame, site: int, catalog: Catalog) -> DataFrame:
    """Edges at `site` from what the site before passed on: (link, suffix, re, im) with suffixes from `site` on."""
    ops = F.col("suffix")
    return passed.select("link", X.onsite_op(ops, site).cast("int").alias("op_id"), X.is_odd(ops, site + 1, catalog).alias("jw"), X.from_site(ops, site + 1).alias("suffix"), "re", "im")


def cut_edges(unique: DataFrame, n_sites: int) -> DataFrame:
    """(cut, prefix, suffix, re, im) for every cut between sites cut and cut + 1."""
    each = unique.select("ops", "re", "im", F.explode(F.sequence(F.lit(1), F.lit(n_sites - 1))).alias("cut")) if n_sites > 1 else unique.select("ops", "re", "im", F.lit(0).alias("cut")).where("false")
    return each.select("cut", X.upto_site(F.col("ops"), F.col("cut")).alias("prefix"), X.from_site(F.col("ops"), F.col("cut") + 1).alias("suffix"), "re", "im")


def sizes(edges: DataFrame, by: list[str], left: list[str], right: list[str]) -> DataFrame:
    """Edge rows (repeats count), left and right vertices of each graph."""
    return edges.groupBy(*by).agg(F.count("*").alias("n_edges"), F.countDistinct(F.struct(*left)).alias("n_left"), F.countDistinct(F.struct(*right)).alias("n_right"))


def compact(rows: DataFrame, payload: str, scratch: Scratch) -> DataFrame:
    """rows with `position`: equal payloads have one number, in the payloads' order from 1."""
    return rows.join(dense_ids(rows, [payload], "position", scratch), payload)


def first_equal(rows: DataFrame, vertex: str, payload: str) -> DataFrame:
    """rows with the least vertex that has the same payload."""
    return rows.join(rows.groupBy(payload).agg(F.min(vertex).alias("first_vertex")), payload)


def numbered(edges: DataFrame, left: list[str], right: list[str], scratch: Scratch) -> DataFrame:
    """Edges added up, with numbers lv and rv of their vertices, in the vertices' order from 1."""
    total = scratch.keep(edges.groupBy(*dict.fromkeys([*left, *right])).agg(F.sum("re").alias("re"), F.sum("im").alias("im")), "added")
    lv, rv = dense_ids(total, left, "lv", scratch), dense_ids(total, right, "rv", scratch)
    return scratch.keep(total.join(lv, left).join(rv, right), "numbered")


def with_components(edges: DataFrame, scratch: Scratch, left: str = "lv", right: str = "rv") -> DataFrame:
    """Edges with their component, named by twice its least left vertex (right vertices are odd numbers meanwhile)."""
    ends = edges.select((F.col(left) * 2).alias("u"), (F.col(right) * 2 + 1).alias("v"))
    found = connected_components(ends, scratch)
    # the least left vertex names a component whatever the right ones are
    lefts = found.where("vertex % 2 = 0").select((F.col("vertex") / 2).cast("long").alias("l"), "component")
    names = lefts.groupBy("component").agg(F.min("l").alias("name"))
    return edges.join(lefts.join(names, "component").select(F.col("l").alias(left), F.col("name").alias("component")), left)


def kinds(edges: DataFrame, *more: Column) -> DataFrame:
    """(component, single, ...): whether each component has a single left vertex, so that it passes on as it is, and further aggregates."""
    return edges.groupBy("component").agg((F.min("lv") == F.max("lv")).alias("single"), *more)


def of_kind(edges: DataFrame, kinds: DataFrame, single: bool) -> DataFrame:
    """The edges of the components with a single left vertex, or of the others."""
    return edges.join(kinds.where(F.col("single") == single).select("component"), "component")


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, n_left, n_right, n_edges)."""
    return edges.groupBy("component").agg(F.countDistinct("lv").alias("n_left"), F.countDistinct("rv").alias("n_right"), F.count("*").alias("n_edges"))


def component_matrix(edges: DataFrame, w: list[str]) -> DataFrame:
    """(component, i, j, lv, rv, w): the weight matrix of each component, rows and columns numbered from 1 within it."""
    total = edges.groupBy("component", "lv", "rv").agg(*(F.sum(x).alias(x) for x in w))
    rows = total.select("component", "lv").distinct().withColumn("i", F.row_number().over(Window.partitionBy("component").orderBy("lv")))
    cols = total.select("component", "rv").distinct().withColumn("j", F.row_number().over(Window.partitionBy("component").orderBy("rv")))
    return total.join(rows, ["component", "lv"]).join(cols, ["component", "rv"])


def describe(edges: DataFrame, n: int, catalog: Catalog) -> str:
    """A graph as text, one line for each of its edges, which are read one partition at a time."""
    rows = edges.orderBy("link", "op_id", X.key_text(F.col("suffix"))).select("link", "op_id", "jw", X.key_text(F.col("suffix")).alias("suffix"), "re", "im").toLocalIterator()
    name = lambda k: catalog.ops[n - 1][k - 1].name
    return "\n".join(f"site {n}: link {r.link}, {name(r.op_id)}{' F' if r.jw else ''} -> [{r.suffix}] {complex(r.re, r.im)}" for r in rows)
