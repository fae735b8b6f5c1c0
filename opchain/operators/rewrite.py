"""Rewriting of same-site products in a basis of operators, and checks of a sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opchain.functions import terms as X
from opchain.operators.terms import runs_on_one_site, times
from opchain.plans.arrow import send_package
from opchain.plans.scratch import Scratch
from opchain.sources.catalog import Catalog


def _scaled(m: np.ndarray) -> tuple[np.ndarray, complex]:
    """A matrix divided by its first non-zero entry in column order, and that entry (0 if there is none)."""
    flat = m.ravel(order="F")
    at = np.flatnonzero(flat)
    return (m / flat[at[0]], complex(flat[at[0]])) if len(at) else (m, 0j)


def products(runs: list[tuple[int, tuple[int, ...]]], given: Catalog, basis: Catalog, tolerance: float = 0.0) -> list[tuple]:
    """(n, ids, basis id, re, im) of products of operators on a site: which basis operator each is, and times what.  Zero products have id 0, those that no operator of the basis is a multiple of have none."""
    out = []
    for n, ids in runs:
        m = np.eye(given.sites[n - 1].dim, dtype=complex)
        for i in ids:
            m = m @ given.ops[n - 1][i - 1].matrix
        unit, scale = _scaled(m)
        if scale == 0:
            out.append((n, list(ids), 0, 0.0, 0.0))
            continue
        for k, o in enumerate(basis.ops[n - 1], 1):
            other, by = _scaled(o.matrix)
            if by != 0 and np.abs(unit - other).max() <= tolerance:
                factor = scale / by
                out.append((n, list(ids), k, factor.real, factor.imag))
                break
        else:
            out.append((n, list(ids), None, 0.0, 0.0))
    return out


def product_table(runs: DataFrame, given: Catalog, basis: Catalog, scratch: Scratch, tolerance: float = 0.0) -> DataFrame:
    """`products` of the different runs (n, ids), multiplied where the runs are.  Raises ValueError if one is not in the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = products([(n, tuple(ids)) for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], given, basis, tolerance)
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64()], strict=True)], ["n", "ids", "id", "re", "im"])

    send_package(runs.sparkSession)
    table = scratch.keep(runs.select("n", "ids").distinct().mapInArrow(run, "n int, ids array<int>, id int, re double, im double"), "products")
    bad = table.where("id is null").orderBy("n", "ids").first()
    if bad:
        names = "*".join(given.ops[bad.n - 1][i - 1].name for i in bad.ids)
        raise ValueError(f"The product {names} on site {bad.n} is not a multiple of a basis operator")
    return table


def rewrite_in_basis(terms: DataFrame, given: Catalog, basis: Catalog, tolerance: float = 0.0) -> DataFrame:
    """Terms with one basis operator a site; ids are the basis's.  Terms sorted by site are expected.

    A term with a vanishing product stays, with coefficient 0 and no operators.  Identities that the
    products give are removed.  The terms are written once; the table of the different runs is joined without a hint, so that it is
    broadcast only if it is small.
    """
    scratch = Scratch(terms.sparkSession, "rewrite")
    terms = scratch.keep(terms, "terms")
    found = runs_on_one_site(terms).join(product_table(runs_on_one_site(terms), given, basis, scratch, tolerance), ["n", "ids"])
    factor = F.aggregate(
        F.collect_list(F.struct("re", "im")), F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")),
        lambda a, x: F.struct((a["re"] * x["re"] - a["im"] * x["im"]).alias("re"), (a["re"] * x["im"] + a["im"] * x["re"]).alias("im")),
    )
    gone = F.max((F.col("id") == 0).cast("int")) == 1
    made = found.groupBy("term_id").agg(factor.alias("factor"), gone.alias("gone"), F.array_sort(F.collect_list(F.struct("n", "id"))).alias("new"))
    none = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    out = terms.join(made, "term_id", "left")
    empty = F.filter("ops", lambda x: F.lit(False))
    coeff: Column = F.when(F.col("factor").isNull(), F.col("coeff")).when(F.col("gone"), none).otherwise(times(F.col("coeff"), F.col("factor")))
    ops = F.when(F.coalesce("gone", F.lit(False)), empty).otherwise(X.without_identity(F.coalesce("new", empty)))
    return out.select("term_id", coeff.alias("coeff"), ops.alias("ops"))


def prepare(terms: DataFrame, given: Catalog, basis: Catalog | None) -> tuple[DataFrame, Catalog]:
    """The terms in the basis if there is one, and the operators their ids now name."""
    return (terms, given) if basis is None else (rewrite_in_basis(terms, given, basis), basis)


def check_independent(catalog: Catalog) -> None:
    """Raises if the operators of some site are linearly dependent or of different sizes."""
    seen: dict[int, bool] = {}
    for n, ops in enumerate(catalog.ops, 1):
        if id(ops) in seen:
            continue
        if len({o.matrix.shape for o in ops}) > 1:
            raise ValueError(f"The operators on site {n} have different sizes")
        if np.linalg.matrix_rank(np.stack([o.matrix.ravel() for o in ops])) < len(ops):
            raise ValueError(f"The operators on site {n} are linearly dependent")
        seen[id(ops)] = True


def term_facts(terms: DataFrame, catalog: Catalog) -> DataFrame:
    """One row of what `check_terms` looks at: n_terms, how many are unsorted or have several operators on one site, and the least and most flux and parity; terms with coefficient 0 are ignored."""
    live = terms.where(F.hypot("coeff.re", "coeff.im") > 0)
    sites = F.transform("ops", lambda x: x["n"])
    pairs = F.arrays_zip(F.slice(sites, 1, F.greatest(F.size(sites) - 1, F.lit(0))).alias("a"), F.slice(sites, 2, F.size(sites)).alias("b"))
    return live.agg(
        F.count("*").alias("n_terms"),
        F.count_if(F.exists(pairs, lambda p: p["a"] > p["b"])).alias("unsorted"),
        F.count_if(F.exists(pairs, lambda p: p["a"] == p["b"])).alias("twice"),
        F.min(X.flux(F.col("ops"), 1, catalog)).alias("least"), F.max(X.flux(F.col("ops"), 1, catalog)).alias("most"),
        F.min(X.is_odd(F.col("ops"), 1, catalog)).alias("even"), F.max(X.is_odd(F.col("ops"), 1, catalog)).alias("odd"),
    )


def check_terms(terms: DataFrame, catalog: Catalog) -> None:
    """Raises unless the terms are sorted, have one operator a site at most, and agree in flux and fermion parity."""
    found = term_facts(terms, catalog).first()
    if found.unsorted:
        raise ValueError("The operators of a term are not sorted by site")
    if found.twice:
        raise ValueError("A term has several operators on one site")
    if found.least != found.most:
        raise ValueError("Inconsistent flux found!")
    if found.even != found.odd:
        raise ValueError("Inconsistent fermion parity found!")


def validate(terms: DataFrame, catalog: Catalog) -> None:
    check_terms(terms, catalog)
    check_independent(catalog)


def merge_number_ops(create: int, destroy: int, number: int):
    """A callback for TermSum: a creation followed by an annihilation operator on one site becomes the number operator."""

    def modify(ops: Column) -> tuple[Column, Column]:
        def is_second(x: Column, k: Column) -> Column:  # x annihilates what the operator before it creates
            before = F.get(ops, k - 1)
            return (k > 0) & (x["id"] == destroy) & (F.coalesce(before["id"], F.lit(0)) == create) & (F.coalesce(before["n"], F.lit(0)) == x["n"])

        def is_first(x: Column, k: Column) -> Column:
            after = F.get(ops, k + 1)
            return (x["id"] == create) & (F.coalesce(after["id"], F.lit(0)) == destroy) & (F.coalesce(after["n"], F.lit(0)) == x["n"])

        marked = F.transform(ops, lambda x, k: F.struct(x["n"].alias("n"), F.when(is_first(x, k), F.lit(number)).otherwise(x["id"]).cast("int").alias("id"), is_second(x, k).alias("gone")))
        kept = F.transform(F.filter(marked, lambda x: ~x["gone"]), lambda x: F.struct(x["n"].alias("n"), x["id"].alias("id")))
        return F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), kept

    return modify
