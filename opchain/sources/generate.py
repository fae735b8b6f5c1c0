"""Sums to build operators from: (term_id, coeff, ops of (name, n)) in the order in which the operators multiply."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A linearly independent basis of the operators that Hubbard-like sums need on an Electron site, in id order.
ELECTRON_BASIS = [
    "I", "Cdn", "Cup", "Cdagdn", "Cdagup", "Ndn", "Nup", "Cup*Cdn", "Cup*Cdagdn", "Cup*Ndn",
    "Cdagup*Cdn", "Cdagup*Cdagdn", "Cdagup*Ndn", "Nup*Cdn", "Nup*Cdagdn", "Nup*Ndn",
]


def _op(name: Column | str, n: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), n.cast("int").alias("n"))


def _terms(df: DataFrame, coeff: Column, *ops: Column, im: Column | None = None) -> DataFrame:
    c = F.struct(coeff.cast("double").alias("re"), (F.lit(0.0) if im is None else im).cast("double").alias("im"))
    return df.select(c.alias("coeff"), F.array(*ops).alias("ops"))


def _numbered(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("term_id", F.monotonically_increasing_id()).select("term_id", "coeff", "ops")


def _digits(spark: SparkSession, base: int, names: list[str]) -> DataFrame:
    """All combinations of numbers 0..base - 1, as digits of one range, so that no join is needed."""
    df = spark.range(base ** len(names))
    for k, name in enumerate(names):
        df = df.withColumn(name, (F.floor(F.col("id") / base**k) % base).cast("int"))
    return df


def hubbard_real_space(spark: SparkSession, n: int, t: float = 1.0, u: float = 4.0) -> DataFrame:
    """A ring of n sites: hops of both spins both ways, and repulsion on each site; 5 n terms."""
    df = spark.range(n).withColumn("a", F.col("id") + 1).withColumn("b", F.col("a") % n + 1)
    a, b = F.col("a"), F.col("b")
    hops = [_terms(df, F.lit(-t), _op(f"Cdag{s}", x), _op(f"C{s}", y)) for s in ("up", "dn") for x, y in ((a, b), (b, a))]
    return _numbered([*hops, _terms(df, F.lit(u), _op("Nup*Ndn", a))])


def hubbard_momentum_space(spark: SparkSession, n: int, t: float = 1.0, u: float = 4.0) -> DataFrame:
    """The same ring in plane waves; n**3 + 2 n terms."""
    one = spark.range(n)
    band = -2 * t * F.cos(2 * pi * F.col("id") / n)
    kinetic = [_terms(one, band, _op(f"N{s}", F.col("id") + 1)) for s in ("up", "dn")]
    df = _digits(spark, n, ["p", "q", "k"])
    to = lambda x: F.pmod(x, F.lit(n)) + 1
    p, q, k = F.col("p"), F.col("q"), F.col("k")
    meeting = _terms(df, F.lit(u / n), _op("Cdagup", to(p - k)), _op("Cdagdn", to(q + k)), _op("Cdn", q + 1), _op("Cup", p + 1))
    return _numbered([*kinetic, meeting])


def transcorrelated_hubbard(spark: SparkSession, n: int, j: float, t: float = 1.0, u: float = 4.0) -> DataFrame:
    """The ring in plane waves after a Gutzwiller similarity transformation with parameter j: about n**5 three-body terms a spin."""
    eps = lambda x: 2 * F.cos(2 * pi * x / n)
    to = lambda x: F.pmod(x, F.lit(n)) + 1
    one = spark.range(n)
    parts = [_terms(one, -t * eps(F.col("id")), _op(f"N{s}", F.col("id") + 1)) for s in ("up", "dn")]
    p, q, k, s, k2 = (F.col(x) for x in ("p", "q", "k", "s", "k2"))
    two, three = _digits(spark, n, ["p", "q", "k"]), _digits(spark, n, ["p", "q", "k", "s", "k2"])
    weight = u / 2 - t * ((F.exp(F.lit(j)) - 1) * eps(p - k) + (F.exp(F.lit(-j)) - 1) * eps(p))
    body = 2 * t * (F.cosh(F.lit(j)) - 1) / n**2 * eps(p - k + k2)
    for a, b in (("up", "dn"), ("dn", "up")):
        parts.append(_terms(two, weight / n, _op(f"Cdag{a}", to(p - k)), _op(f"Cdag{b}", to(q + k)), _op(f"C{b}", q + 1), _op(f"C{a}", p + 1)))
        parts.append(_terms(three, body, _op(f"Cdag{a}", to(p - k)), _op(f"Cdag{b}", to(q + k2)), _op(f"Cdag{b}", to(s + k - k2)), _op(f"C{b}", s + 1), _op(f"C{b}", q + 1), _op(f"C{a}", p + 1)))
    return _numbered(parts)


def reorder_sites(raw: DataFrame, order: list[int]) -> DataFrame:
    """The sum with site n moved to place order[n - 1]; a good order of modes keeps bonds small.  Operators keep their order, so no sign changes here."""
    if sorted(order) != list(range(1, len(order) + 1)):
        raise ValueError("order must hold each site once")
    place = F.array(*map(F.lit, order))
    return raw.withColumn("ops", F.transform("ops", lambda x: _op(x["name"], F.element_at(place, x["n"]))))


def inside_out(n: int) -> list[int]:
    """An order of modes 1 .. n on a ring by distance from mode 1: opposite momenta become neighbours."""
    by_distance = sorted(range(n), key=lambda k: (min(k, n - k), k))
    return [by_distance.index(k) + 1 for k in range(n)]


def electronic_structure(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """One- and two-electron terms with generic coefficients of the symmetry of real integrals; order n**4 terms."""
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 20)) / (1 << 20) - 0.5
    two = _digits(spark, n, ["p", "q"])
    p, q, r, s = (F.col(x) for x in "pqrs")
    h = unit(F.least(p, q), F.greatest(p, q))
    parts = [_terms(two, h, _op(f"Cdag{x}", p + 1), _op(f"C{x}", q + 1)) for x in ("up", "dn")]
    four = _digits(spark, n, ["p", "q", "r", "s"])
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    v = unit(F.least(pair(p, s), pair(q, r)), F.greatest(pair(p, s), pair(q, r))) / 2
    for x in ("up", "dn"):
        for y in ("up", "dn"):
            rows = four.where("p <> q and r <> s") if x == y else four
            parts.append(_terms(rows, v, _op(f"Cdag{x}", p + 1), _op(f"Cdag{y}", q + 1), _op(f"C{y}", r + 1), _op(f"C{x}", s + 1)))
    return _numbered(parts)


def haldane_shastry(spark: SparkSession, n: int) -> DataFrame:
    """Spins on a ring that couple as the inverse square of their chord; 3 n (n - 1) / 2 terms."""
    df = _digits(spark, n, ["a", "b"]).where("a < b")
    a, b = F.col("a") + 1, F.col("b") + 1
    c = (pi / n) ** 2 / F.pow(F.sin(pi * (b - a) / n), 2)
    return _numbered([_terms(df, c, _op("Sz", a), _op("Sz", b)), *(_terms(df, c / 2, _op(x, a), _op(y, b)) for x, y in (("S+", "S-"), ("S-", "S+")))])


def pauli_strings(spark: SparkSession, n: int, weight: int, seed: int = 7) -> DataFrame:
    """Every product of up to `weight` Pauli operators on different sites, with generic coefficients."""
    each = F.explode(F.array(*(F.lit(x) for x in "XYZ")))
    grown = [spark.range(1).select(F.array().cast("array<struct<name:string,n:int>>").alias("ops"), F.lit(0).alias("last"))]
    for _ in range(weight):
        nxt = grown[-1].select("ops", F.explode(F.sequence(F.col("last") + 1, F.lit(n))).alias("at")) if n else grown[-1]
        nxt = nxt.where(F.col("at") <= n).where(F.col("at") > F.coalesce(F.try_element_at("ops", F.lit(-1))["n"], F.lit(0)))
        grown.append(nxt.select("ops", "at", each.alias("x")).select(F.concat("ops", F.array(_op(F.col("x"), F.col("at")))).alias("ops"), F.col("at").alias("last")).where(F.col("last") <= n))
        if n == 0:
            break
    made = []
    for g in grown:
        text = F.array_join(F.transform("ops", lambda x: F.concat_ws(":", x["name"], x["n"])), ",")
        c = F.pmod(F.xxhash64(F.lit(seed), text), F.lit(1 << 20)) / (1 << 20) + 0.1
        made.append(g.select(F.struct(c.alias("re"), F.lit(0.0).alias("im")).alias("coeff"), "ops"))
    return _numbered(made)


def fourier_transform(spark: SparkSession, n: int, reverse_bits: bool = False) -> DataFrame:
    """The discrete Fourier transform of 2**n amplitudes as a sum of products of 00, 01, 10 and 11; 4**n complex terms."""
    df = spark.range(4**n)
    row = [F.shiftright("id", 2 * k).bitwiseAND(F.lit(1)) for k in range(n)]
    col = [F.shiftright("id", 2 * k + 1).bitwiseAND(F.lit(1)) for k in range(n)]
    y = sum((b * 2 ** (k if reverse_bits else n - 1 - k) for k, b in enumerate(row)), F.lit(0))
    x = sum((b * 2 ** (n - 1 - k) for k, b in enumerate(col)), F.lit(0))
    angle = 2 * pi * ((x * y) % 2**n) / 2**n
    ops = [_op(F.concat(row[k].cast("string"), col[k].cast("string")), F.lit(k + 1)) for k in range(n)]
    return _numbered([_terms(df, F.cos(angle) / 2 ** (n / 2), *ops, im=F.sin(angle) / 2 ** (n / 2))])


def product_operator(spark: SparkSession, factors: list[tuple[complex, complex, complex, complex]]) -> DataFrame:
    """The product over sites of a I + b X + c Y + d Z, multiplied out; 4**n terms."""
    n = len(factors)
    df, names = spark.range(4**n), ["I", "X", "Y", "Z"]
    digit = [F.shiftright("id", 2 * k).bitwiseAND(F.lit(3)).cast("int") for k in range(n)]
    re, im = F.lit(1.0), F.lit(0.0)
    for k, f in enumerate(factors):
        a, b = (F.element_at(F.array(*(F.lit(float(v)) for v in part)), digit[k] + 1) for part in ([complex(z).real for z in f], [complex(z).imag for z in f]))
        df = df.withColumn(f"re{k}", re * a - im * b).withColumn(f"im{k}", re * b + im * a)
        re, im = F.col(f"re{k}"), F.col(f"im{k}")
    ops = [_op(F.element_at(F.array(*map(F.lit, names)), digit[k] + 1), F.lit(k + 1)) for k in range(n)]
    return _numbered([_terms(df, re, *ops, im=im)])


def weight_one(spark: SparkSession, n: int, name: str = "X") -> DataFrame:
    """The sum over sites of n times one operator."""
    df = spark.range(n)
    return _numbered([_terms(df, F.col("id") + 1, _op(name, F.col("id") + 1))])
