"""Construction of a matrix product operator from a sum: the loop over sites, checkpoints and resumption.

A site's step labels the components of its graph, decomposes each, numbers the channels through,
and forms the next site's graph.  Sums of up to `local_terms` combined terms (counted first) are
stepped in arrays on the driver, larger ones in distributed steps: single-left components in SQL,
each other component as a group in Python, numbers by range-wise running totals.  With a checkpoint folder each site's
tables are written there, and `resume` goes on after the last whole one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opchain import schema
from opchain.functions import terms as X
from opchain.operators import graph as G
from opchain.operators import rewrite
from opchain.operators.decompose import split
from opchain.operators.terms import combine, from_names, needs_complex
from opchain.plans.arrow import send_package
from opchain.plans.local_chain import Tails, graph_at, step
from opchain.plans.ranges import running_total
from opchain.plans.scratch import Scratch
from opchain.plans.timing import timed
from opchain.sources.catalog import Catalog, SiteType

LOCAL_TERMS = 200_000


@dataclass(frozen=True)
class Options:
    """How to decompose: algorithm QR or VC, QR's tolerance (a multiple of the default one, or absolute), whether to merge sectors of equal quantities; and what times to print (1: of stages, 2: of sites)."""

    alg: str = "QR"
    tol: float = 1.0
    absolute_tol: bool = False
    combine_sectors: bool = False
    output_level: int = 0

    def __post_init__(self) -> None:
        if self.alg not in ("QR", "VC"):
            raise ValueError(f"Unknown algorithm {self.alg}: QR or VC")
        if self.tol < 0:
            raise ValueError("tol must not be negative")


@dataclass
class Mpo:
    """A chain of tensors: parts (schema.PLACED) that name operators, and the links between sites (schema.LINKS)."""

    catalog: Catalog
    parts: DataFrame
    links: DataFrame
    is_complex: bool = True

    def __len__(self) -> int:
        return len(self.catalog)

    def bond_dimensions(self) -> DataFrame:
        """(cut, bond) of the inner links."""
        return self.links.where(f"l between 1 and {len(self) - 1}").groupBy(F.col("l").alias("cut")).agg(F.sum("dim").cast("long").alias("bond"))


Hook = Callable[[int, DataFrame, DataFrame, DataFrame], None]


def _links(site: int, qns: list, ranks: list[int], merge: bool) -> list[tuple]:
    rows: list[tuple] = []
    for q, r in zip(qns, ranks, strict=True):
        if merge and rows and rows[-1][0] == q:
            rows[-1] = (q, rows[-1][1] + r)
        else:
            rows.append((q, r))
    out, offset = [], 0
    for k, (q, r) in enumerate(rows, 1):
        out.append((site, k, [tuple(x) for x in q], r, offset))
        offset += r
    return out


def _run_local(rows: list, catalog: Catalog, o: Options, first: int, keep: Callable | None) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """From passed-on rows (link, suffix, re, im) at site `first`: columns of the parts, and the links, of all sites from there."""
    n, columns, links = len(catalog), [], []
    terms = [tuple((x[0], x[1]) for x in r[1]) for r in rows]
    tails = Tails(catalog, terms)
    link, tail = np.array([r[0] for r in rows]), np.array([tails.number[t] for t in terms])
    w = np.array([r[2] for r in rows])
    if any(r[3] for r in rows):
        w = w + 1j * np.array([r[3] for r in rows])
    for site in range(first, n + 1):
        g = graph_at(site, link, tail, w, tails)
        s = step(g, tails, site == n, o.alg, o.tol, o.absolute_tol, o.combine_sectors)
        left = g.lefts[s.vertex]
        here = (np.full(len(s.vertex), site), s.component, s.right_link, left[:, 0], left[:, 1], left[:, 2].astype(bool), np.real(s.weight).astype(float), np.imag(s.weight).astype(float))
        made = _links(site, s.qns, s.ranks, o.combine_sectors)
        link, tail, w = s.link, s.tail, s.passed
        columns.append(here)
        links += made
        if keep is not None:
            rest = [(a, list(tails.items[t]), float(np.real(v)), float(np.imag(v))) for a, t, v in zip(link.tolist(), tail.tolist(), w.tolist(), strict=True)]
            keep(site, list(zip(*(c.tolist() for c in here), strict=True)), made, rest)
    names = [x.split()[0] for x in schema.PLACED.split(", ")]
    return dict(zip(names, (np.concatenate(c) for c in zip(*columns, strict=True)), strict=True)), links


def numbered_through(ranks: DataFrame, merge: bool, scratch: Scratch) -> DataFrame:
    """Components (component, qn, rank) with `offset`, the number of channels before theirs; with merge, those of one quantity lie together."""
    return running_total(ranks, ["qn", "component"] if merge else ["component"], "rank", "offset", scratch)


def sectors(placed: DataFrame, merge: bool) -> DataFrame:
    """(qn, dim, offset) of each sector of a link: one for each quantity with merge, else one for each component."""
    dim, offset = (F.sum("rank"), F.min("offset")) if merge else (F.col("rank"), F.col("offset"))
    made = [dim.cast("int").alias("dim"), offset.cast("int").alias("offset")]
    return placed.groupBy("qn").agg(*made) if merge else placed.select("qn", *made)


def _distributed_site(edges: DataFrame, site: int, catalog: Catalog, o: Options, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, links, passed on) of one site's edges."""
    last = site == len(catalog)
    numbered = scratch.keep(G.with_components(G.numbered(edges, ["link", "op_id", "jw"], ["suffix"], scratch), scratch), "site")
    kinds = G.kinds(numbered, F.min(F.struct("lv", "rv", "suffix"))["suffix"].alias("suffix"))
    kinds = scratch.keep(kinds.select("component", "single", X.flux(F.col("suffix"), site + 1, catalog).alias("qn")), "kinds")
    one = G.of_kind(numbered, kinds, True)
    weight = (F.sum("re").alias("re"), F.sum("im").alias("im")) if last else (F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    simple = one.groupBy("component", "lv").agg(F.count("*").alias("_n"), *(weight if last else [])) if last else one.select("component", "lv").distinct().withColumns({"re": F.lit(1.0), "im": F.lit(0.0)})
    kind_parts = simple.select("component", F.lit(0).alias("kind"), F.lit(0).alias("m"), F.col("lv").alias("v"), "re", "im", F.lit(1).alias("rank"))
    kind_edges = one.select("component", F.lit(1).alias("kind"), F.lit(0).alias("m"), F.col("rv").alias("v"), "re", "im", F.lit(1).alias("rank"))

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups))
        lv, li = np.unique(t["lv"].to_numpy(), return_inverse=True)
        rv, ri = np.unique(t["rv"].to_numpy(), return_inverse=True)
        re, im = t["re"].to_numpy(), t["im"].to_numpy()
        found = split(o.alg, li, ri, re + 1j * im if im.any() else re, last, o.tol, o.absolute_tol)
        rows = [(0, m, int(lv[i]), v) for m, i, v in found.parts] + [(1, m, int(rv[j]), v) for m, j, v in found.edges]
        kind, m, v, w = zip(*rows, strict=True)
        k = len(rows)
        arrays = [pa.array([t["component"][0].as_py()] * k, pa.int64()), pa.array(kind, pa.int32()), pa.array(m, pa.int32()), pa.array(v, pa.int64()), pa.array(np.real(w).astype(float)), pa.array(np.imag(w).astype(float)), pa.array([found.rank] * k, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["component", "kind", "m", "v", "re", "im", "rank"])

    send_package(edges.sparkSession)
    many = G.of_kind(numbered, kinds, False).select("component", "lv", "rv", "re", "im")
    made = many.groupBy("component").applyInArrow(run, "component long, kind int, m int, v long, re double, im double, rank int")
    rows = scratch.keep(kind_parts.unionByName(kind_edges).unionByName(made), "rows")
    ranks = rows.groupBy("component").agg(F.max("rank").alias("rank")).join(kinds.select("component", "qn"), "component")
    placed = scratch.keep(numbered_through(ranks, o.combine_sectors, scratch), "placed")
    at = rows.join(placed.select("component", "offset"), "component").withColumn("link", (F.col("m") + F.col("offset") + 1).cast("int"))
    lefts, rights = numbered.select("lv", "link", "op_id", "jw").distinct().withColumnRenamed("link", "left_link"), numbered.select("rv", "suffix").distinct()
    parts = at.where("kind = 0").join(lefts, F.col("v") == F.col("lv")).select(F.lit(site).alias("site"), "component", F.col("link").alias("right_link"), "left_link", "op_id", "jw", "re", "im")
    passed = at.where("kind = 1").join(rights, F.col("v") == F.col("rv")).select("link", "suffix", "re", "im")
    one_each = sectors(placed, o.combine_sectors).withColumn("_one", F.lit(1))
    links = running_total(one_each, ["offset"], "_one", "sector", scratch).select(F.lit(site).alias("l"), (F.col("sector") + 1).cast("int").alias("sector"), "qn", "dim", "offset")
    return parts, links, passed.where("false") if last else passed


def _continue(spark: SparkSession, catalog: Catalog, passed: DataFrame, first: int, o: Options, hook: Hook | None, checkpoint: str | None, local_terms: int) -> Mpo:
    scratch, n = Scratch(spark, "chain"), len(catalog)
    passed_schema = f"link int, suffix {schema.OPS}, re double, im double"
    frames: tuple[list[DataFrame], list[DataFrame]] = ([], [])

    def save(site: int, parts: DataFrame, links: DataFrame, following: DataFrame) -> None:
        if checkpoint:
            for name, df in (("parts", parts), ("links", links), ("passed", following)):
                df.write.mode("overwrite").parquet(f"{checkpoint}/{name}/site={site}")
            spark.createDataFrame([(site,)], "site int").coalesce(1).write.mode("overwrite").json(f"{checkpoint}/done/site={site}")
        if hook:
            hook(site, parts, links, following)

    def keep(site: int, parts: list, links: list, following: list) -> None:
        save(site, spark.createDataFrame(parts, schema.PLACED), spark.createDataFrame(links, schema.LINKS), spark.createDataFrame(following, passed_schema))

    if passed.limit(local_terms + 1).count() <= local_terms:
        with timed(spark, "site loop in arrays", o.output_level):
            parts, links = _run_local([tuple(r) for r in passed.select("link", "suffix", "re", "im").collect()], catalog, o, first, keep if hook or checkpoint else None)
        import pandas as pd

        return Mpo(catalog, spark.createDataFrame(pd.DataFrame(parts), schema.PLACED), spark.createDataFrame(links, schema.LINKS))
    for site in range(first, n + 1):
        with timed(spark, f"site {site} of {n}", o.output_level, 2):
            parts, links, following = _distributed_site(G.next_graph(passed, site, catalog), site, catalog, o, scratch)
            parts, links, passed = scratch.keep(parts, "parts"), scratch.keep(links, "links"), scratch.keep(following, "passed")
        save(site, parts, links, passed)
        frames[0].append(parts)
        frames[1].append(links)

    def union(many: list[DataFrame]) -> DataFrame:
        out = many[0]
        for df in many[1:]:
            out = out.unionByName(df)
        return out

    return Mpo(catalog, scratch.keep(union(frames[0]), "all-parts"), scratch.keep(union(frames[1]), "all-links"))


def build(
    terms: DataFrame, catalog: Catalog, options: Options | None = None, basis: Catalog | None = None, check: bool = True, abs_tol: float = 0.0,
    hook: Hook | None = None, checkpoint: str | None = None, local_terms: int = LOCAL_TERMS, is_complex: bool | None = None, check_flux: bool | None = None,
) -> Mpo:
    """The operator of a sum of terms (term_id, coeff, ops) in canonical form.

    is_complex: the type of its values; left out, it is taken from the coefficients and the operators' matrices, and a sum that needs complex values can't be real.
    check_flux (as check, if left out): whether every entry of the finished tensors must carry the flux that its links and states say.
    basis: operators to rewrite same-site products in.  hook is called after each site with its parts, links and what it passes on.
    An empty sum, or one that cancels, raises ValueError.
    """
    spark, o = terms.sparkSession, options or Options()
    with timed(spark, "rewriting", o.output_level):
        terms, catalog = rewrite.prepare(terms, catalog, basis)
    if check:
        with timed(spark, "checks", o.output_level):
            rewrite.validate(terms, catalog)
    unique = combine(terms, abs_tol)
    with timed(spark, "like terms", o.output_level):
        passed = Scratch(spark, "terms").keep(unique.select(F.lit(1).alias("link"), F.col("ops").alias("suffix"), "re", "im"), "unique")
    if passed.isEmpty():
        raise ValueError("The sum has no terms")
    needed = needs_complex(passed.select(F.struct("re", "im").alias("coeff")), catalog)
    if needed and is_complex is False:
        raise ValueError("The sum needs complex values")
    mpo = _continue(spark, catalog, passed, 1, o, hook, checkpoint, local_terms)
    mpo.is_complex = needed if is_complex is None else is_complex
    if check if check_flux is None else check_flux:
        from opchain.operators.tensor import instantiate

        with timed(spark, "flux of the tensors", o.output_level):
            instantiate(mpo)
    return mpo


def build_from_names(raw: DataFrame, sites: list[SiteType], **options) -> Mpo:
    """The operator of a sum of products of named operators (term_id, coeff, ops of (name, n)) in the users' order."""
    from opchain.operators.terms import append

    terms, catalog = from_names(raw, sites)
    return build(append(terms, catalog), catalog, **options)


def finished_sites(spark: SparkSession, checkpoint: str) -> int:
    """The last site up to which a checkpoint folder is whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(hadoop(f"{checkpoint}/done/site={n + 1}/_SUCCESS")):
        n += 1
    return n


def resume(spark: SparkSession, catalog: Catalog, checkpoint: str, options: Options | None = None, hook: Hook | None = None, local_terms: int = LOCAL_TERMS) -> Mpo:
    """Goes on after the last whole site of a checkpoint folder, with the catalog and options of the run that wrote it."""
    done = finished_sites(spark, checkpoint)
    if not done:
        raise ValueError(f"No finished site in {checkpoint}")
    read = lambda name, ddl: spark.read.schema(ddl).parquet(*(f"{checkpoint}/{name}/site={k}" for k in range(1, done + 1)))
    parts, links = read("parts", schema.PLACED), read("links", schema.LINKS)
    if done == len(catalog):
        return Mpo(catalog, parts, links)
    passed = spark.read.schema(f"link int, suffix {schema.OPS}, re double, im double").parquet(f"{checkpoint}/passed/site={done}")
    rest = _continue(spark, catalog, passed, done + 1, options or Options(), hook, checkpoint, local_terms)
    return Mpo(catalog, parts.unionByName(rest.parts), links.unionByName(rest.links))
