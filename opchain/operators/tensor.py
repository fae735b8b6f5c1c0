"""Tensor entries and blocks of a chain, and measures of how sparse they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opchain.plans.arrow import send_package
from opchain.plans.build import Mpo
from opchain.sources.catalog import JORDAN_WIGNER, Catalog


def entries(parts: DataFrame, catalog: Catalog) -> DataFrame:
    """schema.ENTRIES of parts: each weight times its operator's matrix (times the sign of the state it acts on, where a fermion passes), added up; zeros go."""
    spark = parts.sparkSession
    rows = []
    for n, ops in enumerate(catalog.ops, 1):
        d = catalog.sites[n - 1].dim
        for k, o in enumerate(ops, 1):
            for jw in (False, True):
                if jw and d not in JORDAN_WIGNER:
                    continue
                sign = JORDAN_WIGNER[d] if jw else (1,) * d
                rows += [(n, k, jw, i + 1, j + 1, float(o.matrix[i, j].real) * sign[j], float(o.matrix[i, j].imag) * sign[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(o.matrix)), strict=True)]
    bad = [n for n, s in enumerate(catalog.sites, 1) if s.dim not in JORDAN_WIGNER]
    if bad and not parts.where(F.col("jw") & F.col("site").isin(bad)).isEmpty():
        raise ValueError("Unknown fermionic site.")
    table = spark.createDataFrame(rows, "site int, op_id int, jw boolean, i int, j int, m_re double, m_im double")
    each = parts.join(F.broadcast(table), ["site", "op_id", "jw"])  # a few rows for each site and operator
    total = each.groupBy("site", "component", "right_link", "left_link", "i", "j").agg(F.sum(F.col("re") * F.col("m_re") - F.col("im") * F.col("m_im")).alias("re"), F.sum(F.col("re") * F.col("m_im") + F.col("im") * F.col("m_re")).alias("im"))
    return total.where("re <> 0 or im <> 0")


def instantiate(mpo: Mpo, check_flux: bool = True) -> DataFrame:
    """Entries of all tensors.  The outer links have one channel each, so the first left and the last right link are 1 throughout.

    check_flux: raises unless every entry carries the flux that its links and states say.
    """
    out = entries(mpo.parts, mpo.catalog)
    if check_flux and any(s.states[0] for s in mpo.catalog.sites):
        bad = with_flux(out, mpo).where(F.size("wrong") > 0)
        if not bad.isEmpty():
            raise ValueError("A tensor entry does not conserve the quantities of its links")
    return out


def link_table(links: DataFrame) -> DataFrame:
    """(l, position, sector, within, qn): each channel of each link with its sector and its place in it, counted from 1."""
    each = links.select("l", "sector", "qn", "offset", F.posexplode(F.sequence(F.lit(1), "dim")).alias("k", "within"))
    return each.select("l", (F.col("offset") + F.col("within")).alias("position"), "sector", "within", "qn")


def position_map(sectors: DataFrame) -> DataFrame:
    """(index, position, block, within) from sectors (index, block, dim): dense positions of an index with their block and place in it."""
    offset = F.coalesce(F.sum("dim").over(Window.partitionBy("index").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = sectors.withColumn("offset", offset).select("index", "block", "offset", F.explode(F.sequence(F.lit(1), "dim")).alias("within"))
    return each.select("index", (F.col("offset") + F.col("within")).cast("long").alias("position"), "block", "within")


def block_id(left: Column, right: Column, top: Column, bottom: Column, n_right: Column, n_top: Column, n_bottom: Column) -> Column:
    """One number, from 0, for a block's four coordinates, from 1; the left link's varies slowest."""
    return (((left - 1) * n_right + (right - 1)) * n_top + (top - 1)) * n_bottom + (bottom - 1)


def block_of_id(number: Column, n_right: Column, n_top: Column, n_bottom: Column) -> list[Column]:
    """The four coordinates, from 1, of a block's number."""
    div = lambda a, b: F.call_function("div", a, b)  # noqa: E731  in whole numbers: a quotient of doubles is wrong above 2**53
    return [div(number, n_right * n_top * n_bottom) + 1, div(number, n_top * n_bottom) % n_right + 1, div(number, n_bottom) % n_top + 1, number % n_bottom + 1]


def _state_table(mpo: Mpo) -> DataFrame:
    rows = []
    for n, s in enumerate(mpo.catalog.sites, 1):
        at = 0
        for b, (q, d) in enumerate(s.sectors(), 1):
            rows += [(n, at + k + 1, b, d, k + 1, [list(x) for x in q]) for k in range(d)]
            at += d
    return mpo.parts.sparkSession.createDataFrame(rows, "site int, state int, block int, block_dim int, within int, qn array<struct<name:string,val:int,mod:int>>")


def _placed(e: DataFrame, mpo: Mpo) -> DataFrame:
    """Entries with the sectors of both links and the state blocks; outer links are one sector."""
    links = link_table(mpo.links)
    dims = mpo.links.select("l", "sector", F.col("dim").alias("sector_dim"), "qn")
    n = len(mpo)
    right = links.join(dims.select("l", "sector", "sector_dim"), ["l", "sector"]).select(F.col("l").alias("site"), F.col("position").alias("right_link"), F.col("sector").alias("right_sector"), F.col("sector_dim").alias("right_dim"), F.col("qn").alias("right_qn"), F.col("within").alias("right_at"))
    left = right.select((F.col("site") + 1).alias("site"), F.col("right_link").alias("left_link"), F.col("right_sector").alias("left_sector"), F.col("right_dim").alias("left_dim"), F.col("right_qn").alias("left_qn"), F.col("right_at").alias("left_at"))
    states = F.broadcast(_state_table(mpo))
    row = states.select("site", F.col("state").alias("i"), F.col("block").alias("row_block"), F.col("block_dim").alias("row_dim"), F.col("within").alias("row_at"), F.col("qn").alias("row_qn"))
    col = states.select("site", F.col("state").alias("j"), F.col("block").alias("col_block"), F.col("block_dim").alias("col_dim"), F.col("within").alias("col_at"), F.col("qn").alias("col_qn"))
    out = e.join(right, ["site", "right_link"], "left").join(left, ["site", "left_link"], "left").join(row, ["site", "i"]).join(col, ["site", "j"])
    one = lambda c: F.coalesce(c, F.lit(1)).alias(c)
    return out.select("site", "component", "right_link", "left_link", "i", "j", "re", "im", one("right_sector"), one("right_dim"), one("left_sector"), one("left_dim"), one("left_at"), one("right_at"), "row_block", "row_dim", "row_at", "col_block", "col_dim", "col_at", "right_qn", "left_qn", "row_qn", "col_qn", (F.col("site") == n).alias("is_last"))


def block_values(e: DataFrame, mpo: Mpo) -> DataFrame:
    """(site, left_sector, right_sector, row_block, col_block, shape, re, im): blocks that hold an entry, with all their values, zeros too.

    shape is (left, right, row, col), the last varies fastest in the values.  A block is one row, so its size bounds what a task holds;
    no entries give no rows.
    """
    keys = ["site", "left_sector", "right_sector", "row_block", "col_block"]
    dims = [F.col(x).cast("long") for x in ("left_dim", "right_dim", "row_dim", "col_dim")]
    at = block_id(*(F.col(x).cast("long") for x in ("left_at", "right_at", "row_at", "col_at")), *dims[1:])
    placed = _placed(e, mpo).select(*(F.col(k).cast("int").alias(k) for k in keys), F.array(*dims).alias("shape"), at.alias("at"), "re", "im")

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups))
        shape = t["shape"][0].as_py()
        values = np.zeros((2, int(np.prod(shape))))
        for part, name in zip(values, ("re", "im"), strict=True):
            np.add.at(part, t["at"].to_numpy(), t[name].to_numpy())
        arrays = [pa.array([t[k][0].as_py()], pa.int32()) for k in keys] + [pa.array([shape], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in values)], [*keys, "shape", "re", "im"])

    send_package(mpo.parts.sparkSession)
    return placed.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", shape array<long>, re array<double>, im array<double>")


def site_tensor(mpo: Mpo, site: int, limit: int = 1 << 26) -> np.ndarray:
    """One site's whole tensor by (left link, right link, row, col), without blocks; over `limit` values it raises ValueError."""
    s = full_sizes(mpo).where(F.col("site") == site).first()
    shape = (s.left_dim, s.right_dim, s.dim, s.dim)
    if int(np.prod(shape)) > limit:
        raise ValueError("The tensor is too large to be held whole; use its entries or blocks")
    out = np.zeros(shape, complex)
    for r in entries(mpo.parts.where(F.col("site") == site), mpo.catalog).toLocalIterator():
        out[r.left_link - 1, r.right_link - 1, r.i - 1, r.j - 1] += complex(r.re, r.im)
    return out if mpo.is_complex else out.real


def with_flux(e: DataFrame, mpo: Mpo) -> DataFrame:
    """Entries with `wrong`: quantities for which left flux differs from right flux plus what the states change.  The first site's left flux is the sum's own, so it is left out."""
    placed = _placed(e, mpo)

    def value(qn: str, name: str, mod: int) -> Column:
        return F.aggregate(F.filter(F.coalesce(F.col(qn), F.array().cast("array<struct<name:string,val:int,mod:int>>")), lambda x: (x["name"] == name) & (x["mod"] == mod)), F.lit(0), lambda s, x: s + x["val"])

    kinds = sorted({(q[0], q[2]) for s in mpo.catalog.sites for st in s.states for q in st})
    checks = []
    for name, mod in kinds:
        gap = value("left_qn", name, mod) - value("right_qn", name, mod) - value("row_qn", name, mod) + value("col_qn", name, mod)
        off = F.pmod(gap, F.lit(abs(mod))) != 0 if abs(mod) > 1 else gap != 0
        checks.append(F.when((F.col("site") > 1) & off, F.lit(name)))
    return placed.withColumn("wrong", F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>"))


def blocks(e: DataFrame, mpo: Mpo) -> DataFrame:
    """(site, left_sector, right_sector, row_block, col_block, size, n): blocks that hold an entry, their full size and the entries they hold."""
    size = F.first(F.col("left_dim").cast("long") * F.col("right_dim") * F.col("row_dim") * F.col("col_dim"))
    return _placed(e, mpo).groupBy("site", "left_sector", "right_sector", "row_block", "col_block").agg(size.alias("size"), F.count("*").alias("n"))


def full_sizes(mpo: Mpo) -> DataFrame:
    """(site, left_dim, right_dim, dim) of each tensor."""
    n = len(mpo)
    dims = {r.l: r.d for r in mpo.links.groupBy("l").agg(F.sum("dim").alias("d")).collect()}  # a row for each site
    rows = [(s, int(dims[s - 1]) if s > 1 else 1, int(dims[s]) if s < n else 1, mpo.catalog.sites[s - 1].dim) for s in range(1, n + 1)]
    return mpo.parts.sparkSession.createDataFrame(rows, "site int, left_dim long, right_dim long, dim long")


def sparsity(mpo: Mpo, split_blocks: bool = True) -> float:
    """Share of the tensors' elements that are not stored: single entries are with split_blocks, else whole blocks."""
    e = entries(mpo.parts, mpo.catalog)
    stored = e.count() if split_blocks else blocks(e, mpo).agg(F.sum("size")).first()[0] or 0
    full = full_sizes(mpo).agg(F.sum(F.col("left_dim") * F.col("right_dim") * F.col("dim") * F.col("dim"))).first()[0]
    return 1 - stored / full


def link_blocks(mpo: Mpo) -> tuple[int, int]:
    """How many pairs of left and right channels there are in all tensors, and how many of them hold an entry."""
    used = entries(mpo.parts, mpo.catalog).select("site", "left_link", "right_link").distinct().count()
    total = full_sizes(mpo).agg(F.sum(F.col("left_dim") * F.col("right_dim"))).first()[0]
    return int(total), used


def dense(mpo: Mpo) -> np.ndarray:
    """The whole operator as a matrix, for short chains."""
    size = int(np.prod([s.dim for s in mpo.catalog.sites]))
    if size > 4096:
        raise ValueError("The chain is too long for a dense matrix")
    by_site: dict[int, list] = {}
    for r in entries(mpo.parts, mpo.catalog).collect():
        by_site.setdefault(r.site, []).append(r)
    state: dict[int, np.ndarray] = {1: np.ones((1, 1), complex)}
    for site in range(1, len(mpo) + 1):
        d = mpo.catalog.sites[site - 1].dim
        local: dict[tuple[int, int], np.ndarray] = {}
        for r in by_site.get(site, []):
            local.setdefault((r.left_link, r.right_link), np.zeros((d, d), complex))[r.i - 1, r.j - 1] += complex(r.re, r.im)
        new: dict[int, np.ndarray] = {}
        for (a, b), m in local.items():
            if a in state:
                new[b] = new.get(b, 0) + np.kron(state[a], m)
        state = new
    return state.get(1, np.zeros((size, size), complex))
