"""Least bond dimensions: the rank of the weights at every cut, all cuts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opchain.operators.cover import minimum_vertex_cover
from opchain.operators.decompose import drop_rule_qr
from opchain.operators.graph import cut_edges, numbered, with_components
from opchain.plans.arrow import send_package
from opchain.plans.scratch import Scratch


def _local(v: np.ndarray) -> np.ndarray:
    return np.unique(v, return_inverse=True)[1]


def rank_of(lv: np.ndarray, rv: np.ndarray, w: np.ndarray, alg: str, tol: float) -> int:
    i, j = _local(lv), _local(rv)
    if alg == "VC":
        adjacency: list[list[int]] = [[] for _ in range(int(i.max()) + 1)]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            adjacency[x].append(y)
        left, right = minimum_vertex_cover(adjacency, int(j.max()) + 1)
        return len(left) + len(right)
    a = np.zeros((int(i.max()) + 1, int(j.max()) + 1), w.dtype)
    np.add.at(a, (i, j), w)
    a = a if a.shape[0] <= a.shape[1] else a.T  # the longer side as columns costs least; the rank is the same
    return drop_rule_qr(a, tol)[0].shape[1]


def bond_dimensions(unique: DataFrame, n_sites: int, alg: str = "QR", tol: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """(cut, n_components, bond): the rank (QR) or the least vertex cover (VC) of the terms' weights at each cut.

    Components with a single left or right vertex have rank 1 and stay in the JVM; each other one is a group of its own in Python.
    """
    if alg not in ("QR", "VC"):
        raise ValueError(f"Unknown algorithm {alg}: QR or VC")
    scratch = scratch or Scratch(unique.sparkSession, "bonds")
    edges = numbered(cut_edges(unique, n_sites), ["cut", "prefix"], ["cut", "suffix"], scratch).select("cut", "lv", "rv", "re", "im")
    labelled = scratch.keep(with_components(edges, scratch), "labelled")
    kinds = labelled.groupBy("cut", "component").agg((F.min("lv") == F.max("lv")).alias("one_left"), (F.min("rv") == F.max("rv")).alias("one_right"))
    simple = kinds.where("one_left or one_right").select("cut", F.lit(1).cast("long").alias("rank"))
    large = labelled.join(kinds.where("not one_left and not one_right").select("component"), "component")

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups))
        re, im = t["re"].to_numpy(), t["im"].to_numpy()
        w = re + 1j * im if im.any() else re
        rank = rank_of(t["lv"].to_numpy(), t["rv"].to_numpy(), w, alg, tol)
        yield pa.RecordBatch.from_arrays([pa.array([t["cut"][0].as_py()], pa.int32()), pa.array([rank], pa.int64())], ["cut", "rank"])

    send_package(unique.sparkSession)
    ranked = large.groupBy("component").applyInArrow(run, "cut int, rank long")
    return simple.unionByName(ranked).groupBy("cut").agg(F.count("*").alias("n_components"), F.sum("rank").alias("bond"))
