"""Packing of tokenised documents into sequences by linear grouping and best fit.

Tokenising is one Arrow pass.  Packing needs only how many pieces there are of each length, a table
of as many rows as a sequence has tokens, so the driver can plan for any number of documents:
large lengths are put in groups of equal cardinality and rounded up to their group's largest, a
linear programme over the few sizes chooses configurations (column generation), the actual lengths
then take the places of the rounded ones, and what is left goes, largest first, where it fits best.
The plan is in runs of equal sequences.  A piece finds its place from its rank among the pieces of
its length, which is its rank within its partition plus a running count over partitions.

Nulls, empty and odd input: a null text is an empty one, and an empty text is one piece that holds the
end id alone.  A document of any length is tokenised whole.  Repeated rows are packed each on their own, null doc_ids
are kept, an empty table gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opchain.llm import text as T
from opchain.plans.arrow import map_arrow
from opchain.plans.scratch import Scratch

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, at long"
CACHE = 1_500_000  # units of text whose ids a worker remembers, some 50 bytes each
_UNSURE = np.zeros(256, bool)  # bytes that may begin white space after a blank
_UNSURE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = True


class Encoder:
    """Token ids of texts, unit by unit.

    The tokenizer's pattern never joins the last white space of a run, or a sign after a letter, with
    what stands before it, so a text can be cut there, and each different unit is encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]  # never cut
        self._clear()

    def _clear(self) -> None:
        self.n = self.n_ids = 0
        self.begin, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 13, np.uint32)  # unit i has the ids from begin[i] to begin[i + 1]
        self._table(1 << 13)

    def _table(self, size: int) -> None:
        """An empty table of hashes and their units; a hash stands at its own place or the next free one."""
        self.known, self.slot = np.zeros(size, T.U), np.full(size, -1, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The units of hashes, -1 if they are not known."""
        last = T.U(len(self.known) - 1)
        at = (hashes & last).astype(np.int64)
        out = self.slot[at]
        todo = np.flatnonzero((self.known[at] != hashes) & (out >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(last)
            out[todo] = self.slot[at[todo]]
            todo = todo[(self.known[at[todo]] != hashes[todo]) & (out[todo] >= 0)]
        return out

    def _put(self, hashes: np.ndarray, units: np.ndarray) -> None:
        """Adds hashes that are not known, each once."""
        last = len(self.known) - 1
        at = (hashes & T.U(last)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            self.slot[at[free]] = units[free]  # of several that want one place one gets it
            got = free[self.slot[at[free]] == units[free]]
            self.known[at[got]] = hashes[got]
            todo = todo[self.slot[at[todo]] != units[todo]]
            at[todo] = (at[todo] + 1) & last

    def _learn(self, units: list[str], hashes: np.ndarray) -> None:
        found = [e.ids for i in range(0, len(units), 4096) for e in self.tokenizer.encode_batch_fast(units[i : i + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        n, ids = self.n + len(found), self.n_ids + int(size.sum())
        for name, need in (("begin", n + 1), ("flat", ids)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old) * 3 // 2) - len(old), old.dtype)]))
        self.begin[self.n + 1 : n + 1] = self.n_ids + np.cumsum(size)
        self.flat[self.n_ids : ids] = np.fromiter(chain.from_iterable(found), np.uint32, ids - self.n_ids)
        if 2 * n > len(self.known):
            known, slot = self.known[self.slot >= 0], self.slot[self.slot >= 0]
            self._table(1 << (4 * n - 1).bit_length())
            self._put(known, slot)
        self._put(hashes, np.arange(self.n, n, dtype=np.int32))
        self.n, self.n_ids = n, ids

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows, offsets of the rows in them)."""
        everything, offsets = T.buffers(column)
        for a, b in T.slices(offsets):
            data, off = everything[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            n = len(data)
            cut = np.zeros(n + 1, bool)
            last = np.flatnonzero(_BLANK[data[:-1]] & ~_UNSURE[data[1:]]) if n > 1 else np.zeros(0, np.int64)
            cut[last] = True
            cut[last[data[last] != 0x20] + 1] = True
            cut[1:n] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
            raw = data.tobytes()
            for special in self.whole:
                i = raw.find(special)
                while i >= 0:
                    cut[i + 1 : i + len(special)] = False
                    i = raw.find(special, i + 1)
            cut[off] = True
            cut[n] = False
            start = np.flatnonzero(cut)
            end = np.append(start[1:], n)
            hashes = T.segment(data, off, start, end) if n else np.zeros(0, T.U)
            slot = self._find(hashes)
            new = np.flatnonzero(slot < 0)
            if len(new):
                each, first = np.unique(hashes[new], return_index=True)
                if self.n and self.n + len(each) > CACHE:
                    self._clear()
                    each, new = np.unique(hashes, return_index=True)
                    first = np.arange(len(each))
                self._learn([raw[start[i] : end[i]].decode() for i in new[first]], each)
                slot = self._find(hashes)
            begin = self.begin[slot]
            size = self.begin[slot + 1] - begin
            total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
            yield a, ids, total[np.searchsorted(start, off)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, which keeps what it has learned from one task to the next."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """PIECES of every row of docs (and their ids): a document's ids and end_id, longer ones cut, the first piece the shorter one."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = encoder_of(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for a, ids, off in encoder.encode(batch.column(1)):
                rows = len(off) - 1
                n = np.diff(off) + 1
                count = -(-n // capacity)
                doc = np.repeat(np.arange(rows), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * capacity
                begin = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                whole = np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4")
                base = off[:-1] + np.arange(rows)
                lo = base[doc] + begin
                view = memoryview(whole.tobytes())
                crc = np.fromiter((zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(lo.tolist(), (lo + length).tolist(), strict=True)), np.int64, len(doc))
                rank = seen[length] + T.occurrences(np.zeros(len(doc), np.int64), length.astype(T.U))
                seen += np.bincount(length, minlength=capacity + 1)
                out = [batch.column(0).slice(a, rows).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(begin), pa.array(length, pa.int32()), pa.array(crc), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)]
                if with_ids:
                    out.append(T.lists(whole.astype(np.int32), length, pa.int32()))
                yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


@dataclass
class Run:
    """`times` sequences that hold pieces of these lengths, in this order."""

    times: int
    lengths: tuple[int, ...]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """How often to use which counts of each size: the fractional optimum by column generation, rounded down."""
    g = len(sizes)
    b, s = np.array(demand, float), np.array(sizes)
    basis = np.diag([float(capacity // x) for x in sizes])
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(g))
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fits = np.flatnonzero(s <= c)
            gains = value[c - s[fits]] + price[fits]
            k = int(gains.argmax())
            value[c], choice[c] = (gains[k], fits[k]) if gains[k] > value[c - 1] + 1e-12 else (value[c - 1], -1)
        if value[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(g), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= int(s[choice[c]])
        x, d = np.linalg.solve(basis, b), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, b)
    return [(basis[:, i].astype(int).tolist(), int(np.floor(x[i] + 1e-9))) for i in range(g) if x[i] >= 1]


def plan(histogram: dict[int, int], capacity: int = 2048, groups: int = 24, large: int = 8) -> list[Run]:
    """Runs that hold, of each length, as many pieces as the histogram says.  Lengths over capacity / large are large."""
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    runs = [Run(left.pop(capacity), (capacity,))] if capacity in left else []
    big = [k for k in sorted(left, reverse=True) if k > capacity // large]
    if big:
        each = max(1, -(-sum(left[k] for k in big) // groups))
        filled: list[list[list[int]]] = []  # of each group: [length, how many], largest first
        room = 0
        for k in big:
            n = left[k]
            while n:
                if not room:
                    filled.append([])
                    room = each
                take = min(n, room)
                filled[-1].append([k, take])
                n, room = n - take, room - take
        sizes, demand = [x[0][0] for x in filled], [sum(n for _, n in x) for x in filled]
        merged: list[int] = []
        for i in range(len(sizes)):  # groups of one size are one
            if merged and sizes[merged[-1]] == sizes[i]:
                filled[merged[-1]] += filled[i]
                demand[merged[-1]] += demand[i]
            else:
                merged.append(i)
        filled, sizes, demand = [filled[i] for i in merged], [sizes[i] for i in merged], [demand[i] for i in merged]
        for counts, times in configurations(sizes, demand, capacity):
            while times:
                need: dict[tuple[int, int], int] = defaultdict(int)
                lengths: list[int] = []
                for i, a in enumerate(counts):
                    spot, used = 0, 0
                    for _ in range(a):
                        while spot < len(filled[i]) and filled[i][spot][1] <= used:
                            spot, used = spot + 1, 0
                        if spot == len(filled[i]):
                            break
                        used += 1
                        need[i, spot] += 1
                        lengths.append(filled[i][spot][0])
                if not lengths:
                    break
                now = min([times, *(filled[i][p][1] // n for (i, p), n in need.items())])
                for (i, p), n in need.items():
                    filled[i][p][1] -= now * n
                    left[filled[i][p][0]] -= now * n
                for x in filled:
                    x[:] = [y for y in x if y[1]]
                runs.append(Run(now, tuple(lengths)))
                times -= now
    return best_fit(runs, left, capacity)


def best_plan(histogram: dict[int, int], capacity: int = 2048) -> list[Run]:
    """The plan of fewest sequences over some borders between large and small lengths."""
    return min((plan(histogram, capacity, large=x) for x in (8, 4, 3, 2, 1)), key=lambda runs: sum(r.times for r in runs))


def best_fit(runs: list[Run], left: dict[int, int], capacity: int) -> list[Run]:
    """Puts what is left, largest first, into the sequences with the least room that suffices, or into new ones."""
    open_, count = defaultdict(list), np.zeros(capacity + 1, np.int64)

    def put(run: Run) -> None:
        room = capacity - sum(run.lengths)
        open_[room].append(run)
        count[room] += run.times

    for r in runs:
        put(r)
    for length in sorted((k for k, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            fits = np.flatnonzero(count[length:])
            if not len(fits):
                per = capacity // length
                if n >= per:
                    put(Run(n // per, (length,) * per))
                    n %= per
                if n:
                    put(Run(1, (length,) * n))
                break
            room = length + int(fits[0])
            run = open_[room].pop()
            count[room] -= run.times
            now = min(run.times, n)
            if run.times > now:
                open_[room].append(Run(run.times - now, run.lengths))
                count[room] += run.times - now
            put(Run(now, (*run.lengths, length)))
            n -= now
    return [r for room in open_.values() for r in room]


def places(runs: list[Run], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By length and rank: keys length * 2**44 + first rank, sequence of that rank, offset in it; and how many equal places follow."""
    out, seen, base = [], np.zeros(capacity + 1, np.int64), 0
    for r in runs:
        offset = 0
        for x in r.lengths:
            out.append(((x << 44) + int(seen[x]), base, offset, r.times))
            seen[x] += r.times
            offset += x
        base += r.times
    rows = np.array(sorted(out), np.int64).reshape(-1, 4)
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Written PIECES with sequence_id and offset, gapless from 0, instead of part and at."""
    spark = cut.sparkSession
    counted = cut.groupBy("part", "length").count()
    runs = best_plan({r.length: r.n for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    key, sequence, offset, _ = places(runs, capacity)
    shared = spark.sparkContext.broadcast((key, sequence, offset))  # bounded by the number of lengths, not of pieces
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("at", F.col("at") + F.col("base")).drop("part", "base").select(*(c for c in cut.columns if c != "part"))
    names = [c for c in ranked.columns if c != "at"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "at") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset = shared.value
        for batch in batches:
            want = (batch.column("length").to_numpy().astype(np.int64) << 44) + batch.column("at").to_numpy()
            i = np.searchsorted(key, want, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[i] + want - key[i]), pa.array(offset[i])], [*names, "sequence_id", "offset"])

    return map_arrow(ranked, run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.keep(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids; a sequence has at most the capacity in ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
