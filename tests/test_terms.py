"""Terms: fixtures with known values."""

import pytest
from pyspark.sql import functions as F

from opchain import schema
from opchain.functions import terms as X
from opchain.operators import rewrite
from opchain.operators.terms import TermSum, append, combine, from_names, needs_complex
from opchain.sources.catalog import Catalog, OpInfo, SiteType, site_type


def ops_of(spark, *ops):
    return spark.createDataFrame([([(n, i) for i, n in ops],)], f"ops {schema.OPS}")


def value(df, column):
    return df.select(column.alias("x")).first().x


FERMIONS = Catalog.uniform("Fermion", 10, ["I", "C", "Cdag", "N"])


def test_onsite_and_suffix(spark):
    df = ops_of(spark, (5, 7), (1, 10))
    assert [value(df, X.onsite_op(F.col("ops"), n)) for n in range(1, 11)] == [5 if n == 7 else 1 for n in range(1, 11)]
    two = spark.createDataFrame([([(7, 5), (10, 1)], [(2, 3), (7, 5), (10, 1)])], f"a {schema.OPS}, b {schema.OPS}")
    assert [value(two, X.equal_from(F.col("a"), F.col("b"), n)) for n in range(11)] == [False] * 3 + [True] * 8


def test_parity(spark):
    df = ops_of(spark, (3, 2), (2, 5))
    assert [value(df, X.is_odd(F.col("ops"), n, FERMIONS)) for n in range(1, 7)] == [False, False, True, True, True, False]


@pytest.mark.parametrize(
    ("ops", "sign", "out"),
    [
        ([(1, 4), (4, 2), (4, 1)], 1, [(4, 1), (4, 2), (1, 4)]),
        ([(2, 2), (3, 1)], -1, [(3, 1), (2, 2)]),
        ([(4, 5), (2, 4), (3, 4), (2, 1)], 1, [(2, 1), (2, 4), (3, 4), (4, 5)]),
        ([(3, 1), (3, 2), (2, 2), (2, 1)], 1, [(3, 1), (2, 1), (3, 2), (2, 2)]),
    ],
)
def test_fermion_sort(spark, ops, sign, out):
    df = ops_of(spark, *ops)
    assert value(df, X.fermion_sign(F.col("ops"), FERMIONS)) == sign
    assert [(o.id, o.n) for o in value(df, X.sorted_by_site(F.col("ops")))] == out


def test_rewrite_paulis(spark):
    given, basis = Catalog.uniform("Qubit", 2, ["I", "Z", "X", "Y"], False), Catalog.uniform("Qubit", 2, ["I", "X", "Y", "Z"], False)
    t = TermSum(spark, given).add(2.0, (3, 1), (4, 1), (3, 2)).frame()
    row = rewrite.rewrite_in_basis(t, given, basis).first()
    assert (row.coeff.re, row.coeff.im) == (0, 2) and [(o.id, o.n) for o in row.ops] == [(4, 1), (2, 2)]


def test_rewrite_zero_products(spark):
    s = TermSum(spark, FERMIONS)
    s.add(1, (3, 1), (3, 1), (2, 2), (2, 3)).add(-2, (2, 4), (2, 4)).add(3, (3, 5), (2, 6)).add(4, (2, 7), (3, 8), (2, 9), (2, 9))
    rows = {r.term_id: r for r in rewrite.rewrite_in_basis(s.frame(), FERMIONS, FERMIONS).collect()}
    assert len(rows) == 4 and all(rows[k].coeff.re == 0 and not rows[k].ops for k in (0, 1, 3))
    assert rows[2].coeff.re == 3 and [(o.id, o.n) for o in rows[2].ops] == [(3, 5), (2, 6)]


def test_identity_from_products_is_removed(spark):
    q = Catalog.uniform("Qubit", 2, ["I", "X", "Y", "Z"], False)
    t = TermSum(spark, q).add(1, (2, 1), (2, 1), (2, 2)).add(1, (2, 2)).frame()
    rows = combine(rewrite.rewrite_in_basis(t, q, q)).collect()
    assert len(rows) == 1 and rows[0].re == 2


def test_products_outside_the_basis(spark):
    q = Catalog.uniform("Qubit", 1, ["I", "X", "Y"], False)
    with pytest.raises(ValueError, match="not a multiple"):
        rewrite.rewrite_in_basis(TermSum(spark, q).add(1, (2, 1), (3, 1)).frame(), q, q)


def test_dependent_operators():
    for names in (["I", "X", "X"], ["I", "X", "W"]):
        kind = site_type("Qubit", False).with_ops(W=[(0, 0, 1), (1, 1, 1), (0, 1, 1), (1, 0, 1)])
        with pytest.raises(ValueError, match="dependent"):
            rewrite.check_independent(Catalog.uniform(kind, 1, names))


def test_parity_and_flux_checks(spark):
    ok = TermSum(spark, FERMIONS).add(1, (2, 1)).add(1, (3, 1), (2, 2), (2, 3)).frame()
    rewrite.check_terms(ok, FERMIONS)
    plain = Catalog.uniform("Fermion", 3, ["I", "C", "Cdag", "N"], conserve=False)
    with pytest.raises(ValueError, match="Inconsistent fermion parity found!"):
        rewrite.check_terms(TermSum(spark, plain).add(1, (2, 1)).add(1, (4, 2)).frame(), plain)
    q = Catalog.uniform("Qubit", 4, ["I", "S-"])
    good = TermSum(spark, q).add(1, (2, 1), (2, 4)).add(1, (2, 2), (2, 3)).frame()
    rewrite.validate(good, q)
    assert value(good, X.flux(F.col("ops"), 1, q))[0].val == 2
    with pytest.raises(ValueError, match="Inconsistent flux found!"):
        rewrite.check_terms(TermSum(spark, q).add(1, (2, 1)).add(1, (2, 2), (2, 3)).frame(), q)


def test_term_sum(spark):
    s = TermSum(spark, FERMIONS, abs_tol=0.5).add(0.5, (2, 1)).add(1j, [(2, 2), (1, 3), (3, 1)])
    assert len(s) == 1 and s[1] == (-1j, [(3, 1), (2, 2)])
    with pytest.raises(IndexError):
        s[0]
    assert needs_complex(s.frame(), FERMIONS)
    with pytest.raises(ValueError, match="first operator"):
        Catalog.from_names([site_type("Qubit")], [["X", "I"]])
    x = OpInfo.of("X", site_type("Qubit", False))
    with pytest.raises(ValueError, match="identity"):
        Catalog((site_type("Qubit", False),), ((x,),)).checked()
    with pytest.raises(ValueError, match="definite flux"):
        OpInfo.of("X", site_type("Qubit"))
    assert isinstance(site_type("Electron"), SiteType)


def test_number_operators_by_callback(spark):
    c = Catalog.uniform("Fermion", 3, ["I", "C", "Cdag", "N"])
    t = TermSum(spark, c, modify=rewrite.merge_number_ops(3, 2, 4)).add(1, (3, 2), (2, 2)).add(2, (3, 1), (2, 3))
    assert t[0] == (1, [(4, 2)]) and t[1] == (2, [(3, 1), (2, 3)])


def test_names_by_first_appearance(spark):
    raw = spark.createDataFrame([(0, (1.0, 0.0), [("X", 2), ("I", 1)]), (1, (1.0, 0.0), [("Z", 2), ("X", 1)])], schema.RAW_TERMS)
    t, c = from_names(raw, [site_type("Qubit", False)] * 2)
    assert [[o.name for o in x] for x in c.ops] == [["I", "X"], ["I", "X", "Z"]]
    assert {r.term_id: [(o.id, o.n) for o in r.ops] for r in append(t, c).collect()} == {0: [(2, 2)], 1: [(2, 1), (3, 2)]}


def test_combine_tolerance_and_nothing(spark):
    q = Catalog.uniform("Qubit", 1, ["I", "X"], False)
    t = TermSum(spark, q).add(1, (2, 1)).add(-1, (2, 1)).frame()
    assert combine(t).count() == 0
    assert combine(TermSum(spark, q).frame()).count() == 0
