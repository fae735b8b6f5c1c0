"""Decompositions of one component's weight matrix: rank-revealing QR with a drop rule, and vertex cover.

Both turn edges (left vertex, right vertex, weight) into m channels: parts (channel, left vertex, weight) that
make the local tensor, and edges (channel, right vertex, weight) that go on to the next site.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from opchain.operators.cover import minimum_vertex_cover

DENSE_LIMIT = 64 << 20  # entries of a component's dense matrix


@dataclass
class Split:
    rank: int
    parts: list[tuple[int, int, complex]]
    edges: list[tuple[int, int, complex]]


def drop_rule_qr(a: np.ndarray, tol: float = 1.0, absolute: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Q and R with a = Q R, where a column whose remainder has a norm of at most the tolerance adds no column to Q.

    The tolerance is tol, or else tol times 20 (rows + columns) eps times the largest column norm.  Columns
    are taken in their order; there is no pivoting.
    """
    if tol < 0:
        raise ValueError("tol must not be negative")
    m, n = a.shape
    norms = np.sqrt((np.abs(a) ** 2).sum(0)) if n else np.zeros(0)
    limit = tol if absolute else tol * 20 * (m + n) * np.finfo(float).eps * (norms.max() if n else 0.0)
    q = np.zeros((m, min(m, n)), a.dtype)
    r = np.zeros((min(m, n), n), a.dtype)
    k = 0
    for j in range(n):
        v = a[:, j].copy()
        for _ in range(2):  # twice, so that Q stays orthogonal
            if k:
                h = q[:, :k].conj().T @ v
                v -= q[:, :k] @ h
                r[:k, j] += h
        size = np.sqrt((np.abs(v) ** 2).sum())
        if size > limit and k < m:
            q[:, k], r[k, j] = v / size, size
            k += 1
    return q[:, :k], r[:k]


def split_qr(left: np.ndarray, right: np.ndarray, w: np.ndarray, last: bool, tol: float, absolute: bool) -> Split:
    """By QR.  left, right: vertices counted from 0 within the component; repeated edges add up."""
    rows, cols = int(left.max()) + 1, int(right.max()) + 1
    if rows * cols > DENSE_LIMIT:
        raise MemoryError(f"A component of {rows} x {cols} vertices is too large for QR; use the vertex cover")
    a = np.zeros((rows, cols), w.dtype)
    np.add.at(a, (left, right), w)
    if rows == 1:
        q, r = np.ones((1, 1), w.dtype), a
    else:
        q, r = drop_rule_qr(a, tol, absolute)
    if last:  # one right vertex: its weight goes into the tensor
        q = q @ r
        r = np.ones((q.shape[1], 1), w.dtype)
    i, m = np.nonzero(q)
    k, j = np.nonzero(r)
    return Split(q.shape[1], list(zip(m.tolist(), i.tolist(), q[i, m].tolist(), strict=True)), list(zip(k.tolist(), j.tolist(), r[k, j].tolist(), strict=True)))


def split_cover(left: np.ndarray, right: np.ndarray, w: np.ndarray, last: bool) -> Split:
    """By a minimum vertex cover: a channel for each covered left vertex, which passes its edges on, then one for each covered right vertex, which gathers those of the uncovered left ones."""
    n_left, n_right = int(left.max()) + 1, int(right.max()) + 1
    adjacency: list[list[int]] = [[] for _ in range(n_left)]
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        adjacency[x].append(y)
    cl, cr = minimum_vertex_cover(adjacency, n_right)
    at_left, at_right = {v: m for m, v in enumerate(cl)}, {v: m + len(cl) for m, v in enumerate(cr)}
    parts: dict[tuple[int, int], complex] = {} if last else {(m, v): 1.0 for v, m in at_left.items()}
    edges: dict[tuple[int, int], complex] = {} if last else {(m, v): 1.0 for v, m in at_right.items()}
    for x, y, v in zip(left.tolist(), right.tolist(), w.tolist(), strict=True):
        if x in at_left and not last:
            key = (at_left[x], y)
            edges[key] = edges.get(key, 0.0) + v
        else:  # at the last site there is one right vertex, and the weight has nowhere else to go
            key = (at_left[x] if x in at_left else at_right[y], x)
            parts[key] = parts.get(key, 0.0) + v
    return Split(len(cl) + len(cr), [(m, x, v) for (m, x), v in parts.items()], [(m, y, v) for (m, y), v in edges.items()])


def split(alg: str, left: np.ndarray, right: np.ndarray, w: np.ndarray, last: bool = False, tol: float = 1.0, absolute: bool = False) -> Split:
    """By "QR" or "VC"."""
    if alg == "QR":
        return split_qr(left, right, w, last, tol, absolute)
    if alg == "VC":
        return split_cover(left, right, w, last)
    raise ValueError(f"Unknown algorithm {alg}: QR or VC")
