"""Kinds of sites, their states and local operators, and the table of operators of a chain.

The table has a few rows a site, so it is made on the driver; frames get it as a broadcast.  Columns about
operators (is it fermionic, its conserved quantities) are literals taken from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opchain import schema

Qn = tuple[tuple[str, int, int], ...]  # sorted (name, value, modulus)


def qn(*parts: tuple) -> Qn:
    """A conserved quantity: (name, value) or (name, value, modulus) each; values are reduced by a modulus over 1, zeros stay."""
    out: dict[tuple[str, int], int] = {}
    for name, val, *mod in parts:
        key = (name, mod[0] if mod else 1)
        out[key] = out.get(key, 0) + val
    return tuple(sorted((name, val % abs(mod) if abs(mod) > 1 else val, mod) for (name, mod), val in out.items()))


def add(a: Qn, b: Qn, sign: int = 1) -> Qn:
    return qn(*a, *((name, sign * val, mod) for name, val, mod in b))


def _matrix(d: int, *entries: tuple[int, int, complex]) -> np.ndarray:
    m = np.zeros((d, d), complex)
    for i, j, v in entries:
        m[i, j] = v
    return m


#: Local operators by kind of site, as (row, column, value) from 0.  Electron states: empty, up, down, both.
_TWO = {
    "I": [(0, 0, 1), (1, 1, 1)], "X": [(0, 1, 1), (1, 0, 1)], "Y": [(0, 1, -1j), (1, 0, 1j)], "Z": [(0, 0, 1), (1, 1, -1)], "S+": [(0, 1, 1)], "S-": [(1, 0, 1)],
    "00": [(0, 0, 1)], "01": [(0, 1, 1)], "10": [(1, 0, 1)], "11": [(1, 1, 1)],
}
_SPIN = {"I": _TWO["I"], "Sz": [(0, 0, 0.5), (1, 1, -0.5)], "S+": [(0, 1, 1)], "S-": [(1, 0, 1)], "Sx": [(0, 1, 0.5), (1, 0, 0.5)], "Sy": [(0, 1, -0.5j), (1, 0, 0.5j)]}
_FERMION = {"I": _TWO["I"], "C": [(0, 1, 1)], "Cdag": [(1, 0, 1)], "N": [(1, 1, 1)], "F": [(0, 0, 1), (1, 1, -1)]}
_ELECTRON = {
    "I": [(k, k, 1) for k in range(4)], "F": [(0, 0, 1), (1, 1, -1), (2, 2, -1), (3, 3, 1)],
    "Cup": [(0, 1, 1), (2, 3, 1)], "Cdagup": [(1, 0, 1), (3, 2, 1)], "Cdn": [(0, 2, 1), (1, 3, -1)], "Cdagdn": [(2, 0, 1), (3, 1, -1)],
    "Nup": [(1, 1, 1), (3, 3, 1)], "Ndn": [(2, 2, 1), (3, 3, 1)], "Nupdn": [(3, 3, 1)], "Ntot": [(1, 1, 1), (2, 2, 1), (3, 3, 2)],
}
_FERMIONIC = {"C", "Cdag", "Cup", "Cdagup", "Cdn", "Cdagdn"}
#: Operators with this eigenvalue sign on each state carry a fermion over a site, by dimension.
JORDAN_WIGNER = {2: (1, -1), 4: (1, -1, -1, 1)}


@dataclass(frozen=True)
class SiteType:
    """A kind of site: its basis states' conserved quantities, and its elementary operators by name.  Products are named A*B."""

    name: str
    states: tuple[Qn, ...]
    ops: dict[str, list] = field(hash=False)

    @property
    def dim(self) -> int:
        return len(self.states)

    def matrix(self, name: str) -> np.ndarray:
        out = np.eye(self.dim, dtype=complex)
        for part in name.split("*"):
            if part not in self.ops:
                raise ValueError(f"Unknown operator {part} on a site of type {self.name}")
            out = out @ _matrix(self.dim, *self.ops[part])
        return out

    def sectors(self) -> list[tuple[Qn, int]]:
        """Runs of states with equal quantities, with their dimensions."""
        out: list[tuple[Qn, int]] = []
        for q in self.states:
            if out and out[-1][0] == q:
                out[-1] = (q, out[-1][1] + 1)
            else:
                out.append((q, 1))
        return out

    def with_ops(self, **more: list) -> SiteType:
        """The same kind with further operators."""
        return SiteType(self.name, self.states, self.ops | more)


def site_type(kind: str, conserve: bool = True) -> SiteType:
    """Qubit, S=1/2, Fermion or Electron, with or without conserved quantities."""
    ops = {"Qubit": _TWO, "S=1/2": _SPIN, "Fermion": _FERMION, "Electron": _ELECTRON}[kind]
    states = {
        "Qubit": (qn(("Number", 0)), qn(("Number", 1))),
        "S=1/2": (qn(("Sz", 1)), qn(("Sz", -1))),
        "Fermion": (qn(("Nf", 0, -1)), qn(("Nf", 1, -1))),
        "Electron": (qn(("Nf", 0, -1), ("Sz", 0)), qn(("Nf", 1, -1), ("Sz", 1)), qn(("Nf", 1, -1), ("Sz", -1)), qn(("Nf", 2, -1), ("Sz", 0))),
    }[kind]
    return SiteType(kind, states if conserve else ((),) * len(states), ops)


@dataclass(frozen=True)
class OpInfo:
    """One local operator: name, matrix, whether it is fermionic, and its flux."""

    name: str
    matrix: np.ndarray
    is_fermionic: bool
    flux: Qn

    @staticmethod
    def of(name: str, site: SiteType) -> OpInfo:
        m = site.matrix(name)
        found = {add(site.states[i], site.states[j], -1) for i, j in zip(*np.nonzero(m), strict=True)}
        if len(found) > 1:
            raise ValueError(f"Operator {name} has no definite flux on a site of type {site.name}")
        odd = sum(part in _FERMIONIC for part in name.split("*")) % 2 == 1
        return OpInfo(name, m, odd, found.pop() if found else ())


@dataclass(frozen=True)
class Catalog:
    """The operators of each site of a chain; ids count from 1, and id 1 is the identity."""

    sites: tuple[SiteType, ...]
    ops: tuple[tuple[OpInfo, ...], ...]

    @staticmethod
    def from_names(sites: Sequence[SiteType], names: Sequence[Sequence[str]]) -> Catalog:
        """From operator names for each site, in id order; the first must be "I"."""
        if len(sites) != len(names):
            raise ValueError(f"{len(names)} lists of operators for {len(sites)} sites")
        for n, x in enumerate(names, 1):
            if not x or x[0] != "I":
                raise ValueError(f"The first operator on site {n} must be I")
        made: dict[tuple[int, tuple[str, ...]], tuple[OpInfo, ...]] = {}
        return Catalog(tuple(sites), tuple(made.setdefault((id(s), tuple(x)), tuple(OpInfo.of(o, s) for o in x)) for s, x in zip(sites, names, strict=True)))

    @staticmethod
    def uniform(kind: str | SiteType, n: int, names: Sequence[str], conserve: bool = True) -> Catalog:
        site = site_type(kind, conserve) if isinstance(kind, str) else kind
        return Catalog.from_names([site] * n, [list(names)] * n)

    def checked(self) -> Catalog:
        """Itself, if each site's first operator is the identity matrix."""
        if len(self.sites) != len(self.ops):
            raise ValueError(f"{len(self.ops)} lists of operators for {len(self.sites)} sites")
        for n, x in enumerate(self.ops, 1):
            if not x or not np.array_equal(x[0].matrix, np.eye(self.sites[n - 1].dim)):
                raise ValueError(f"The first operator on site {n} must be the identity")
        return self

    def __len__(self) -> int:
        return len(self.sites)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The operators as rows of schema.OP_CACHE."""
        rows = [
            (n, k, o.name, len(o.matrix), o.matrix.real.ravel().tolist(), o.matrix.imag.ravel().tolist(), o.is_fermionic, [list(q) for q in o.flux])
            for n, x in enumerate(self.ops, 1)
            for k, o in enumerate(x, 1)
        ]
        return spark.createDataFrame(rows, schema.OP_CACHE)

    def sites_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, s.name, s.dim, [([list(x) for x in q], d) for q, d in s.sectors()]) for n, s in enumerate(self.sites, 1)]
        return spark.createDataFrame(rows, schema.SITES)

    @cached_property
    def _kinds(self) -> list[tuple[tuple[OpInfo, ...], list[int]]]:
        """Different operator lists with the sites that have them."""
        out: dict[tuple, tuple[tuple[OpInfo, ...], list[int]]] = {}
        for n, x in enumerate(self.ops, 1):
            out.setdefault(tuple((o.name, o.is_fermionic, o.flux) for o in x), (x, []))[1].append(n)
        return list(out.values())

    def per_op(self, n: Column, op_id: Column, value, default) -> Column:
        """value(OpInfo) of the operator op_id on site n, as a literal lookup; `default` for ids that are not in the table."""

        def table(x: tuple[OpInfo, ...]) -> Column:
            return F.coalesce(F.try_element_at(F.array(*(F.lit(value(o)) for o in x)), op_id.cast("int")), F.lit(default))

        if len(self._kinds) == 1:
            return table(self._kinds[0][0])
        which = F.element_at(F.array(*(F.lit(next(k for k, (_, s) in enumerate(self._kinds) if i in s)) for i in range(1, len(self) + 1))), n.cast("int"))
        out = F.lit(default)
        for k, (x, _) in enumerate(self._kinds):
            out = F.when(which == k, table(x)).otherwise(out)
        return out

    def fermionic(self, x: Column) -> Column:
        """Whether an operator struct (n, id) is fermionic."""
        return self.per_op(x["n"], x["id"], lambda o: o.is_fermionic, False)

    @cached_property
    def quantities(self) -> list[tuple[str, int]]:
        """(name, modulus) of all conserved quantities."""
        return sorted({(name, mod) for x, _ in self._kinds for o in x for name, _, mod in o.flux})

    @property
    def is_real(self) -> bool:
        return all(not o.matrix.imag.any() for x, _ in self._kinds for o in x)
