"""Operators built site by site, against dense matrices and known bond dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opchain import schema
from opchain.operators import tensor as T
from opchain.operators.terms import append, combine, from_names
from opchain.plans.bonds import bond_dimensions
from opchain.plans.build import Options, build, build_from_names, finished_sites, resume
from opchain.sources import generate as W
from opchain.sources.catalog import JORDAN_WIGNER, Catalog, OpInfo, site_type
from opchain.sources.files import read_hopping, read_terms, write_terms
from opchain.streaming.ingest import ingested, stream_terms


def exact(rows, sites):
    size = int(np.prod([s.dim for s in sites]))
    out = np.zeros((size, size), complex)
    for r in rows:
        m = np.eye(size, dtype=complex) * complex(r.coeff.re, r.coeff.im)
        for o in r.ops:
            info, k = OpInfo.of(o.name, sites[o.n - 1]), np.ones((1, 1), complex)
            for n, s in enumerate(sites, 1):
                string = np.diag(JORDAN_WIGNER[s.dim]) if info.is_fermionic and n < o.n else np.eye(s.dim)
                k = np.kron(k, info.matrix if n == o.n else string)
            m = m @ k
        out += m
    return out


def bonds(mpo):
    return [r.bond for r in mpo.bond_dimensions().orderBy("cut").collect()]


def odd_terms(spark):
    return spark.createDataFrame([(0, (0.7, 0.0), [("Cdag", 1)]), (1, (-1.2, 0.0), [("Cdag", 3)]), (2, (0.4, 0.0), [("Cdag", 5)]), (3, (0.9, 0.0), [("Cdag", 1), ("Cdag", 3), ("C", 5)])], schema.RAW_TERMS)


@pytest.mark.parametrize("alg", ["QR", "VC"])
@pytest.mark.parametrize("conserve", [True, False])
def test_odd_parity(spark, alg, conserve):
    raw, sites = odd_terms(spark), [site_type("Fermion", conserve)] * 5
    m = build_from_names(raw, sites, options=Options(alg))
    T.instantiate(m)
    assert np.abs(T.dense(m) - exact(raw.collect(), sites)).max() < 1e-12


@pytest.mark.parametrize("options", [Options("QR"), Options("VC", combine_sectors=True)])
def test_distributed_site_steps(spark, options):
    raw, sites = spark.createDataFrame([(0, (2.0, 0.0), [("Cdag", 1), ("C", 2)]), (1, (2.0, 0.0), [("Cdag", 2), ("C", 1)]), (2, (0.5, 0.0), [("N", 3)]), (3, (1.0, 1.0), [("N", 1), ("N", 3)])], schema.RAW_TERMS), [site_type("Fermion")] * 3
    small, large = (build_from_names(raw, sites, options=options, local_terms=k) for k in (10**6, 0))
    assert bonds(small) == bonds(large)
    assert np.abs(T.dense(large) - exact(raw.collect(), sites)).max() < 1e-12
    T.instantiate(large)


@pytest.mark.parametrize("alg", ["QR", "VC"])
def test_last_weight_is_kept(spark, alg):
    raw, sites = spark.createDataFrame([(0, (2.0, 0.0), [("X", 1), ("X", 2)])], schema.RAW_TERMS), [site_type("Qubit", False)] * 2
    m = build_from_names(raw, sites, options=Options(alg))
    assert bonds(m) == [1] and np.allclose(T.dense(m), exact(raw.collect(), sites))


@pytest.mark.parametrize("alg", ["QR", "VC"])
@pytest.mark.parametrize("combine_sectors", [True, False])
def test_hubbard(spark, alg, combine_sectors):
    o = Options(alg, combine_sectors=combine_sectors)
    sites = [site_type("Electron")] * 4
    raw = W.hubbard_real_space(spark, 4)
    m = build_from_names(raw, sites, options=o)
    assert bonds(m) == [6, 10, 6] and np.abs(T.dense(m) - exact(raw.collect(), sites)).max() < 1e-12
    raw = W.hubbard_momentum_space(spark, 4, u=1.5)
    m = build_from_names(raw, sites, options=o, basis=Catalog.uniform("Electron", 4, W.ELECTRON_BASIS))
    assert np.abs(T.dense(m) - exact(raw.collect(), sites)).max() < 1e-12
    assert alg == "VC" or max(bonds(m)) == 10 * 4 - 4


def test_known_ranks(spark):
    m = build_from_names(W.hubbard_real_space(spark, 10), [site_type("Electron")] * 10)
    assert bonds(m) == [6, *[10] * 7, 6]
    assert bonds(build_from_names(W.pauli_strings(spark, 8, 4), [site_type("Qubit", False)] * 8)) == [4, 16, 53, 80, 53, 16, 4]
    assert max(bonds(build_from_names(W.weight_one(spark, 60), [site_type("Qubit", False)] * 60))) == 2
    assert max(bonds(build_from_names(W.haldane_shastry(spark, 40), [site_type("S=1/2")] * 40))) == 62


def test_product_and_fourier(spark):
    f = [(1, 2, 3j, 0.5), (0.3, 1, 1, 1j), (1, 1, 1, 2)]
    sites = [site_type("Qubit", False)] * 3
    raw = W.product_operator(spark, f)
    m = build_from_names(raw, sites)
    x, y, z = (sites[0].matrix(k) for k in "XYZ")
    want = np.ones((1, 1))
    for a, b, c, d in f:
        want = np.kron(want, a * np.eye(2) + b * x + c * y + d * z)
    assert bonds(m) == [1, 1] and np.allclose(T.dense(m), want)
    raw = W.fourier_transform(spark, 3)
    w = np.exp(2j * np.pi / 8)
    m = build_from_names(raw, sites, check=False)
    assert np.allclose(T.dense(m), np.array([[w ** (i * j) for j in range(8)] for i in range(8)]) / np.sqrt(8))


def test_ranks_at_all_cuts_at_once(spark):
    terms, catalog = from_names(W.pauli_strings(spark, 6, 3), [site_type("Qubit", False)] * 6)
    unique = combine(append(terms, catalog))
    found = [r.bond for r in bond_dimensions(unique, 6).orderBy("cut").collect()]
    assert found == bonds(build(append(terms, catalog), catalog))
    with pytest.raises(ValueError, match="Unknown algorithm"):
        bond_dimensions(unique, 6, alg="LU")


def test_reordered_modes(spark, capsys):
    raw, sites = W.hubbard_momentum_space(spark, 4), [site_type("Electron")] * 4
    moved = W.reorder_sites(raw, W.inside_out(4))
    assert W.inside_out(4) == [1, 2, 4, 3]
    m = build_from_names(moved, sites, options=Options(output_level=1), basis=Catalog.uniform("Electron", 4, W.ELECTRON_BASIS))
    assert np.abs(T.dense(m) - exact(moved.collect(), sites)).max() < 1e-12
    assert "site loop" in capsys.readouterr().out
    with pytest.raises(ValueError, match="each site once"):
        W.reorder_sites(raw, [1, 1, 2, 3])


def test_three_body_terms(spark):
    raw, sites = W.transcorrelated_hubbard(spark, 3, -0.3), [site_type("Electron")] * 3
    m = build_from_names(raw, sites, basis=Catalog.uniform("Electron", 3, W.ELECTRON_BASIS))
    assert np.abs(T.dense(m) - exact(raw.collect(), sites)).max() < 1e-11


def test_empty_sums(spark):
    q = Catalog.uniform("Qubit", 2, ["I", "X"], False)
    for rows in ([], [(0, (1.0, 0.0), [(1, 2)]), (1, (-1.0, 0.0), [(1, 2)])]):
        with pytest.raises(ValueError, match="no terms"):
            build(spark.createDataFrame(rows, schema.TERMS), q)
    with pytest.raises(ValueError, match="Unknown algorithm"):
        Options("LU")


@pytest.mark.parametrize("local_terms", [10**6, 0])
def test_checkpoint_and_resume(spark, tmp_path, local_terms):
    raw, sites = odd_terms(spark), [site_type("Fermion")] * 5
    terms, catalog = from_names(raw, sites)
    terms, folder = append(terms, catalog), str(tmp_path / "c")

    class Stop(Exception):
        pass

    def hook(site, *_):
        if site == 3:
            raise Stop

    with pytest.raises(Stop):
        build(terms, catalog, hook=hook, checkpoint=folder, local_terms=local_terms)
    assert finished_sites(spark, folder) == 3
    m = resume(spark, catalog, folder, local_terms=10**6)
    assert np.abs(T.dense(m) - exact(raw.collect(), sites)).max() < 1e-12
    again = resume(spark, catalog, folder)
    assert bonds(again) == bonds(m)


def test_blocks_and_measures(spark):
    m = build_from_names(W.hubbard_real_space(spark, 4), [site_type("Electron")] * 4, options=Options(combine_sectors=True))
    e = T.entries(m.parts, m.catalog)
    b = T.blocks(e, m)
    assert b.agg(F.sum("n")).first()[0] == e.count() and b.where("n > size").count() == 0
    assert 0 < T.sparsity(m, False) <= T.sparsity(m) < 1
    total, used = T.link_blocks(m)
    assert total == 6 + 60 + 60 + 6 and 0 < used <= total
    n = [3, 4, 2, 5]
    ids = spark.range(3 * 4 * 2 * 5).select("id", *(c.alias(x) for c, x in zip(T.block_of_id(F.col("id"), *map(F.lit, n[1:])), "abcd", strict=True)))
    back = T.block_id(*(F.col(x) for x in "abcd"), *map(F.lit, n[1:]))
    assert ids.where(back != F.col("id")).count() == 0
    at = T.position_map(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "index int, block int, dim int"))
    assert sorted((r.position, r.block, r.within) for r in at.collect()) == [(1, 1, 1), (2, 1, 2), (3, 2, 1)]
    bad = m.parts.where("site = 1").withColumn("jw", F.lit(True))
    three = Catalog.uniform(site_type("Qubit", False).__class__("Trit", ((), (), ()), {"I": [(0, 0, 1), (1, 1, 1), (2, 2, 1)]}), 1, ["I"])
    with pytest.raises(ValueError, match="Unknown fermionic site"):
        T.entries(bad.withColumn("op_id", F.lit(1)), three)


def test_files_and_streams(spark, tmp_path):
    path = tmp_path / "h.txt"
    path.write_text("# N=3\n1 2 0.5\n2  1\t0.5\n\n2 3 -1e-9\n")
    raw = read_hopping(spark, str(path))
    assert sorted((r.coeff.re, [(o.name, o.n) for o in r.ops]) for r in raw.collect()) == [(-1e-9, [("Cdag", 2), ("C", 3)]), (0.5, [("Cdag", 1), ("C", 2)]), (0.5, [("Cdag", 2), ("C", 1)])]
    terms, catalog = from_names(raw, [site_type("Fermion")] * 3)
    write_terms(terms, str(tmp_path / "in"))
    assert read_terms(spark, str(tmp_path / "in")).count() == 3
    stream = spark.readStream.schema(terms.schema).parquet(str(tmp_path / "in"))
    q = stream_terms(stream, catalog, str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination(120)
    got = {tuple((o.id, o.n) for o in r.ops): r.re for r in ingested(spark, str(tmp_path / "out")).collect()}
    want = {tuple((o.id, o.n) for o in r.ops): r.re for r in combine(append(terms, catalog)).collect()}
    assert got == want


def test_block_values_and_site_tensors(spark):
    m = build_from_names(W.hubbard_real_space(spark, 4), [site_type("Electron")] * 4, options=Options(combine_sectors=True))
    e = T.entries(m.parts, m.catalog)
    rows, sizes = T.block_values(e, m).collect(), {tuple(r)[:5]: r for r in T.blocks(e, m).collect()}
    assert len(rows) == len(sizes)
    for r in rows:
        b = sizes[tuple(r)[:5]]
        assert len(r.re) == len(r.im) == b["size"] == np.prod(r["shape"]) and np.count_nonzero(r.re) == b.n
    assert T.block_values(e.where("false"), m).count() == 0
    state = np.ones((1, 1, 1))
    for n in range(1, 5):
        t = T.site_tensor(m, n)
        assert t.dtype == float
        state = np.einsum("lab,lrij->raibj", state, t).reshape(t.shape[1], state.shape[1] * 4, -1)
    assert np.abs(state[0] - T.dense(m)).max() < 1e-12
    with pytest.raises(ValueError, match="too large"):
        T.site_tensor(m, 2, 10)


def test_value_type(spark):
    sites = [site_type("Qubit", False)] * 2
    real, turned = (spark.createDataFrame([(0, (1.0, im), [("X", 1), ("X", 2)])], schema.RAW_TERMS) for im in (0.0, 1.0))
    assert not build_from_names(real, sites).is_complex and build_from_names(turned, sites).is_complex
    assert build_from_names(real, sites, is_complex=True).is_complex
    with pytest.raises(ValueError, match="complex"):
        build_from_names(turned, sites, is_complex=False)
