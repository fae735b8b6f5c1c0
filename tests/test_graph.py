"""Components, matchings, covers and the numbers over total orders, against brute force."""

import time
import itertools
import random

import numpy as np
import pytest

from opchain.operators import graph as G
from opchain.operators.components import connected_components
from opchain.operators.cover import maximum_matching, minimum_vertex_cover
from opchain.operators.decompose import drop_rule_qr, split
from opchain.plans.ranges import dense_ids, running_total
from opchain.plans.scratch import Scratch


def least_cover(adjacency, n_right):
    edges = [(i, j) for i, a in enumerate(adjacency) for j in a]
    n = len(adjacency)
    return next(k for k in range(n + n_right + 1) if any(all(i in c or n + j in c for i, j in edges) for c in map(set, itertools.combinations(range(n + n_right), k))))


def check_cover(adjacency, n_right):
    left, right = minimum_vertex_cover(adjacency, n_right)
    assert left == sorted(left) and right == sorted(right)
    assert all(i in left or j in right for i, a in enumerate(adjacency) for j in a)
    matched, partners = maximum_matching(adjacency, n_right)
    assert all(partners[r] == v and r in adjacency[v] for v, r in enumerate(matched) if r >= 0)
    assert len(left) + len(right) == sum(r >= 0 for r in matched)
    return len(left) + len(right)


@pytest.mark.parametrize(
    ("adjacency", "size"),
    [([], 0), ([[1], []], 1), ([[0], [1], [2]], 3), ([[0, 1, 2, 3]], 1), ([[0, 1], [1], [3], []], 3), ([[], [1], []], 1), ([[0, 0, 1], [1, 1]], 2), ([[0, 0, 1, 1], [1, 2], [3, 3, 4], []], 3)],
)
def test_small_covers(adjacency, size):
    assert check_cover(adjacency, 5) == size


def test_random_covers():
    rng = random.Random(1234)
    for _ in range(200):
        n, m = rng.randint(0, 5), rng.randint(0, 5)
        adjacency = [[rng.randrange(m) for _ in range(rng.randint(0, 5))] if m else [] for _ in range(n)]
        assert check_cover(adjacency, m) == least_cover(adjacency, m)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(400)] + [(7, 7), (None, 3)]
    found = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert found == {v: top(v) for v in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_matrix(spark):
    rows = [(1, 2, 1.5), (1, 5, -2.0), (2, 2, 3.0), (3, 1, 4.0)]
    e = G.with_components(spark.createDataFrame(rows, "lv long, rv long, w double"), Scratch(spark, "t"))
    m = {(r.component, r.i, r.j): r.w for r in G.component_matrix(e, ["w"]).collect()}
    assert m == {(1, 1, 1): 1.5, (1, 1, 2): -2.0, (1, 2, 1): 3.0, (3, 1, 1): 4.0}
    twice = G.with_components(spark.createDataFrame([(1, 1, 1.5), (1, 1, -0.5), (1, 2, 3.0), (2, 2, 4.0), (2, 2, -1.0)], "lv long, rv long, w double"), Scratch(spark, "t"))
    assert sorted((r.i, r.j, r.w) for r in G.component_matrix(twice, ["w"]).collect()) == [(1, 1, 1.0), (1, 2, 3.0), (2, 2, 3.0)]


def test_compaction(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate([10, 10, 20, 20, 20, 30], 1)], "v long, p long")
    found = {r.v: r.position for r in G.compact(rows, "p", Scratch(spark, "t")).collect()}
    assert [found[k] for k in range(1, 7)] == [1, 1, 2, 2, 2, 3]
    assert {r.v: r.first_vertex for r in G.first_equal(rows, "v", "p").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6}


def test_running_total(spark):
    df = spark.range(500).selectExpr("(id * 37) % 500 as k", "(id * 37) % 500 % 7 as v")
    got = {r.k: r.t for r in running_total(df, ["k"], "v", "t", Scratch(spark, "t")).collect()}
    assert got == {k: sum(x % 7 for x in range(k)) for k in range(500)}
    ids = {r.v: r.n for r in dense_ids(df, ["v"], "n", Scratch(spark, "t")).collect()}
    assert ids == {k: k + 1 for k in range(7)}


def test_drop_rule_qr():
    rng = np.random.default_rng(3)
    for m, n, r in ((6, 9, 3), (5, 5, 5), (1, 4, 1), (7, 3, 2)):
        a = rng.normal(size=(m, r)) @ rng.normal(size=(r, n))
        q, rr = drop_rule_qr(a)
        assert q.shape[1] == r and np.allclose(q @ rr, a) and np.allclose(q.T @ q, np.eye(r))
    assert drop_rule_qr(np.zeros((3, 3)))[0].shape[1] == 0
    assert drop_rule_qr(np.diag([1.0, 1e-3]), 1e-2, absolute=True)[0].shape[1] == 1
    with pytest.raises(ValueError, match="negative"):
        drop_rule_qr(np.eye(2), -1)
    with pytest.raises(ValueError, match="Unknown algorithm"):
        split("LU", np.zeros(1, int), np.zeros(1, int), np.ones(1))


def test_written_tables_leave_no_shuffle_files(spark):
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().repartitionByRange(3, "k"), "counts")
    assert {r.k: r["count"] for r in kept.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {n.split("_")[1] for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    seen = shuffles()
    scratch.keep(spark.range(1000).selectExpr("id % 3 as k").groupBy("k").count(), "again")
    for _ in range(50):  # they are deleted in the background
        if shuffles() <= seen:
            break
        time.sleep(0.2)
    assert shuffles() <= seen
