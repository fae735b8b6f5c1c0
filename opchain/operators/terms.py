"""Sums of products of local operators: ingestion, canonical form, and combination of like terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opchain import schema
from opchain.functions import terms as X
from opchain.sources.catalog import Catalog, SiteType

Modify = Callable[[Column], Column | tuple[Column, Column]]


def times(a: Column, b: Column | float) -> Column:
    """Product of a complex struct and a complex struct or a real factor."""
    if isinstance(b, Column):
        return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))
    return F.struct((a["re"] * b).alias("re"), (a["im"] * b).alias("im"))


def size_of(c: Column) -> Column:
    return F.hypot(c["re"], c["im"])


def append(terms: DataFrame, catalog: Catalog, abs_tol: float = 0.0, modify: Modify | None = None) -> DataFrame:
    """Terms in canonical form: no identity factors, operators sorted by site with the fermionic sign in the coefficient.

    Terms with a coefficient of at most abs_tol go first, by the coefficient as given.  modify takes the sorted operators and
    returns a real factor, or a complex factor and new operators; it comes last.  Like terms are not merged.
    """
    kept = terms.where(size_of(F.col("coeff")) > abs_tol).withColumn("ops", X.without_identity(F.col("ops")))
    sign = X.fermion_sign(F.col("ops"), catalog).cast("double")
    out = kept.select("term_id", times(F.col("coeff"), F.struct(sign.alias("re"), F.lit(0.0).alias("im"))).alias("coeff"), X.sorted_by_site(F.col("ops")).alias("ops"))
    if modify is None:
        return out
    made = modify(F.col("ops"))
    if isinstance(made, tuple):
        factor, ops = made
        return out.select("term_id", times(F.col("coeff"), factor).alias("coeff"), ops.alias("ops"))
    return out.withColumn("coeff", times(F.col("coeff"), F.struct(made.cast("double").alias("re"), F.lit(0.0).alias("im"))))


class TermSum:
    """A sum that terms can be added to, with a table of operators for each site.

    Terms added one by one wait on the driver until `frame` is asked for; frames of terms are added as they are.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, abs_tol: float = 0.0, modify: Modify | None = None) -> None:
        self.spark, self.catalog, self.abs_tol, self.modify = spark, catalog.checked(), abs_tol, modify
        self._waiting: list[tuple] = []
        self._frames: list[DataFrame] = []
        self._next = 0

    def add(self, scalar: complex, *ops: tuple[int, int] | Iterable[tuple[int, int]]) -> TermSum:
        """Adds scalar times a product of operators (id, site), given one by one or as one list."""
        given = list(ops[0]) if len(ops) == 1 and ops[0] and not isinstance(ops[0][0], int) else list(ops)  # type: ignore[index]
        c = complex(scalar)
        self._waiting.append((self._next, (c.real, c.imag), [(n, i) for i, n in given]))
        self._next += 1
        return self

    def add_frame(self, terms: DataFrame) -> TermSum:
        """Adds many terms (term_id, coeff, ops)."""
        self._frames.append(terms.select("term_id", "coeff", "ops"))
        return self

    def frame(self) -> DataFrame:
        """All terms in canonical form."""
        raw = self.spark.createDataFrame(self._waiting, schema.TERMS)
        for f in self._frames:
            raw = raw.unionByName(f)
        return append(raw, self.catalog, self.abs_tol, self.modify)

    def __len__(self) -> int:
        return self.frame().count()

    def __getitem__(self, term_id: int) -> tuple[complex, list[tuple[int, int]]]:
        row = self.frame().where(F.col("term_id") == term_id).first()
        if row is None:
            raise IndexError(term_id)
        return complex(row.coeff.re, row.coeff.im), [(x.id, x.n) for x in row.ops]


def first_appearance(raw: DataFrame) -> DataFrame:
    """(n, name, op_id): ids of operator names on each site in the order in which terms use them, from 2; I is left out."""
    used = raw.select("term_id", F.posexplode("ops").alias("p", "o")).select("term_id", "p", "o.n", "o.name").where("name <> 'I'")
    first = used.groupBy("n", "name").agg(F.min(F.struct("term_id", "p")).alias("first"))
    return first.select("n", "name", (F.row_number().over(Window.partitionBy("n").orderBy("first")) + 1).alias("op_id"))  # a site has few operators


def from_names(raw: DataFrame, sites: list[SiteType]) -> tuple[DataFrame, Catalog]:
    """Terms with ids instead of operator names, and the table of operators that the terms use."""
    ids = first_appearance(raw)
    names: list[list[str]] = [["I"] for _ in sites]
    for r in sorted(ids.collect(), key=lambda r: (r.n, r.op_id)):  # a row for each site and operator
        if not 1 <= r.n <= len(sites):
            raise ValueError(f"No site {r.n} in a chain of {len(sites)}")
        names[r.n - 1].append(r.name)
    each = raw.select("term_id", "coeff", F.posexplode_outer("ops").alias("p", "o")).select("term_id", "coeff", "p", "o.n", "o.name")
    known = each.join(F.broadcast(ids), ["n", "name"], "left")
    ops = F.transform(F.array_sort(F.collect_list(F.when(F.col("op_id").isNotNull(), F.struct("p", "n", "op_id")))), lambda x: F.struct(x["n"].alias("n"), x["op_id"].alias("id")))
    return known.groupBy("term_id").agg(F.first("coeff").alias("coeff"), ops.alias("ops")), Catalog.from_names(sites, names)


def combine(terms: DataFrame, abs_tol: float = 0.0) -> DataFrame:
    """(ops, re, im): like terms added up; sums of at most abs_tol go, exact zeros always.  Partial sums are formed before the shuffle."""
    total = terms.groupBy("ops").agg(F.sum("coeff.re").alias("re"), F.sum("coeff.im").alias("im"))
    return total.where(F.hypot("re", "im") > abs_tol)


def runs_on_one_site(terms: DataFrame) -> DataFrame:
    """(term_id, n, ids): the operators of each term on each site, in their order."""
    each = terms.select("term_id", F.posexplode("ops").alias("p", "o")).select("term_id", "p", "o.n", "o.id")
    return each.groupBy("term_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "id"))), lambda x: x["id"]).alias("ids"))


def needs_complex(terms: DataFrame, catalog: Catalog) -> bool:
    """Whether a coefficient or an operator's matrix has an imaginary part."""
    return not catalog.is_real or bool(terms.agg(F.bool_or(F.col("coeff.im") != 0)).first()[0])


def total_flux(terms: DataFrame, catalog: Catalog) -> DataFrame:
    """terms with the sum of their operators' conserved quantities."""
    return terms.withColumn("flux", X.flux(F.col("ops"), 1, catalog))
