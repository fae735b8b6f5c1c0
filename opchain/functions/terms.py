"""Column expressions over the operators of a term, array<struct<n, id>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opchain.sources.catalog import Catalog


def op(n: int, op_id: int) -> Column:
    """The operator op_id on site n; these structs order by site, then id."""
    return F.struct(F.lit(n).cast("int").alias("n"), F.lit(op_id).cast("int").alias("id"))


def without_identity(ops: Column) -> Column:
    return F.filter(ops, lambda x: x["id"] != 1)


def sorted_by_site(ops: Column) -> Column:
    """Stable by site: operators on one site keep their order."""
    placed = F.transform(ops, lambda x, k: F.struct(x["n"].alias("n"), k.alias("k"), x["id"].alias("id")))
    return F.transform(F.array_sort(placed), lambda x: F.struct(x["n"].alias("n"), x["id"].alias("id")))


def fermion_sign(ops: Column, catalog: Catalog) -> Column:
    """(-1) to the number of pairs of fermionic operators whose sites descend; operators on one site are not swapped."""
    sites = F.transform(F.filter(ops, catalog.fermionic), lambda x: x["n"])
    swaps = F.aggregate(F.transform(sites, lambda a, k: F.size(F.filter(F.slice(sites, k + 2, F.size(sites)), lambda b: b < a))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(sites) < 2, F.lit(1)).otherwise(F.when(swaps % 2 == 1, F.lit(-1)).otherwise(F.lit(1)))


def onsite_op(ops: Column, n: Column | int) -> Column:
    """Id of the first operator on site n, or 1."""
    return F.coalesce(F.try_element_at(F.filter(ops, lambda x: x["n"] == n), F.lit(1))["id"], F.lit(1))


def from_site(ops: Column, n: Column | int) -> Column:
    """The operators on sites from n on; two terms are equal from n on if these are."""
    return F.filter(ops, lambda x: x["n"] >= n)


def upto_site(ops: Column, n: Column | int) -> Column:
    return F.filter(ops, lambda x: x["n"] <= n)


def equal_from(a: Column, b: Column, n: Column | int) -> Column:
    return from_site(a, n) == from_site(b, n)


def is_odd(ops: Column, n: Column | int, catalog: Catalog) -> Column:
    """Whether the number of fermionic operators on sites from n on is odd."""
    return F.size(F.filter(ops, lambda x: (x["n"] >= n) & catalog.fermionic(x))) % 2 == 1


def _value_of(catalog: Catalog, name: str, mod: int):
    def value(x: Column) -> Column:
        return catalog.per_op(x["n"], x["id"], lambda o: next((v for q, v, m in o.flux if (q, m) == (name, mod)), 0), 0)

    return value


def flux(ops: Column, n: Column | int, catalog: Catalog) -> Column:
    """Sum of the conserved quantities of the operators on sites from n on, as a sorted array of structs."""
    kept = from_site(ops, n)
    parts = []
    for name, mod in catalog.quantities:
        total = F.aggregate(F.transform(kept, _value_of(catalog, name, mod)), F.lit(0), lambda s, x: s + x)
        total = F.pmod(total, F.lit(abs(mod))) if abs(mod) > 1 else total
        parts.append(F.struct(F.lit(name).alias("name"), total.cast("int").alias("val"), F.lit(mod).cast("int").alias("mod")))
    return F.array(*parts) if parts else F.array().cast("array<struct<name:string,val:int,mod:int>>")


def descending(ops: Column) -> Column:
    """The operators from the last site to the first."""
    return F.reverse(ops)


def key_text(ops: Column) -> Column:
    """n:id|n:id, from the last site to the first."""
    return F.array_join(F.transform(descending(ops), lambda x: F.concat_ws(":", x["n"], x["id"])), "|")
