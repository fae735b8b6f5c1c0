"""What the operators on repeated text share: distinct texts, runs of equal keys in one sorted order, and rows dealt out in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opchain.llm import text as T
from opchain.plans.arrow import map_arrow
from opchain.plans.scratch import Scratch

BLOCK_ROWS = 1 << 19  # rows that are held to be dealt out in blocks
OFTEN = 64  # rows of one key of some that are dealt out together, beyond which they need no others to be known as shared
BLOCKS = "bucket int, data binary"
MAP_BITS = 1 << 28  # of a map of keys at most; beyond that more rows pass it that have none of the keys


def distinct_texts(marked: DataFrame) -> DataFrame:
    """(doc_id, first) of rows (doc_id, text_key): the least doc_id among those with the same text.  Null doc_ids are left out."""
    known = marked.where("doc_id is not null")
    least = known.groupBy("text_key").agg(F.min("doc_id").alias("first"))
    return known.select("doc_id", "text_key").distinct().join(least, "text_key").groupBy("doc_id").agg(F.min("first").alias("first"))


def partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def neighbours(batches: Iterator[pa.RecordBatch], own: list[str], first: list[str], counted: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of batches (key, doc, pos, ...), sorted by key and, if first is given, by doc and pos, whose key several docs have, and those of the first and the last key.

    first: names for the doc and pos of the key's first row, if wanted; counted: a name for the rows of the key so far.  edge is 0, or for rows of the
    first or last key 1, or 2 if several docs are known to have that key.  Of a last key that several have, its last row stands for all.
    """
    held: list[np.ndarray] = []  # the open run's rows that are not yet given
    state: tuple | None = None  # the open run: key, doc and pos of its first row, whether several docs have it, its rows so far without the held ones, whether it is the partition's first

    def out(column: list[np.ndarray], take: np.ndarray, heads: list[np.ndarray], count: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        columns = [*(c[take] for c in column), *(h[take] for h, _ in zip(heads, first, strict=False)), *(count[take].astype(np.int32) for _ in counted), edge[take]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*own, *first, *counted, "edge"])

    for batch in batches:
        if not len(batch):
            continue
        column = [c.to_numpy() for c in batch.columns]
        if held:
            column = [np.concatenate(x) for x in zip(held, column, strict=True)]
        key, doc = column[:2]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        heads = [c[begin] for c in column[1:3]]
        least, last = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
        several, count, leading = least != last, size.copy(), np.zeros(len(begin), bool)
        if state is None:
            leading[0] = True
        elif state[0] == key[0]:
            heads[0][0], heads[1][0] = state[1:3]
            several[0] |= state[3] or heads[0][0] != least[0] or heads[0][0] != last[0]
            count[0] += state[4]
            leading[0] = state[5]
        # of the run that may go on: its rows, its last row if several docs have it, none if it is an edge anyway
        keep = 0 if leading[-1] else 1 if several[-1] else int(size[-1])
        held = [c[len(key) - keep :] for c in column] if keep else []
        state = (key[-1], heads[0][-1], heads[1][-1], bool(several[-1]), int(count[-1]) - keep, bool(leading[-1]))
        take = np.repeat(several | leading, size)
        take[len(key) - keep :] = False
        if take.any():
            edge = np.where(leading, 1 + several, 0).astype(np.int8)
            yield out(column, take, [np.repeat(h, size) for h in heads], np.repeat(count, size), np.repeat(edge, size))
    if held:
        n = len(held[0])
        yield out(held, np.ones(n, bool), [np.full(n, state[1]), np.full(n, state[2], held[2].dtype)], np.full(n, state[4] + n), np.full(n, 1 + state[3], np.int8))


def shared_runs(rows: DataFrame, scratch: Scratch, extra: tuple[str, ...] = (), owners: bool = True, sizes: bool = False) -> DataFrame:
    """(key, doc, pos, extra, owner, owner_pos) of rows (key, doc, pos, extra) whose key another doc has too; the owner is the first of them by doc and pos.

    Without owners only the rows themselves are given.  With sizes n says how many rows have the key, as far as they are counted when the row is given: within its partition, up to the end of its batch.

    The rows are sorted by key, doc and pos over all partitions (within them by key alone if no owner is asked for), and neighbours are compared within
    each, a batch at a time: of a run that goes on in the next batch only the rows of its first doc are held until
    another doc has the key too.  Ranges split even a single key's rows, so no key can overload a task; the runs at either
    end of a partition, which may go on in the next, are two keys a partition and are settled at the end.
    rows must be a written table: sorting reads it twice.  The result reads a written table as well, which Scratch.drop() takes away.
    """
    own = ["key", "doc", "pos", *extra]
    first = ["owner", "owner_pos"] if owners else []
    counted = ["n"] if sizes else []
    ranged = rows.select(*own).repartitionByRange(partitions(rows), "key", "doc", "pos").sortWithinPartitions(*(own[:3] if owners else own[:1]))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in own), *(f"{c} {kinds[x]}" for c, x in zip(first, own[1:], strict=False)), *(f"{c} int" for c in counted), "edge tinyint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return neighbours(batches, own, first, counted)

    scanned = scratch.keep(map_arrow(ranged, run, schema), "runs")
    edges = scanned.where("edge > 0").groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("last"), F.max("edge").alias("edge"), *([F.min(F.struct(*first)).alias("f")] if owners else []))
    ends = edges.where("least <> last or edge = 2").select("key", *(["f.*"] if owners else [])).orderBy("key").toArrow()  # two keys a partition at most
    if not owners:
        known = ", ".join(map(str, ends.column("key").to_pylist()))
        out = scanned.where(f"edge = 0 or key in ({known})" if known else "edge = 0").drop("edge")
        out.scratch_path = scanned.scratch_path  # type: ignore[attr-defined]
        return out
    shared = rows.sparkSession.sparkContext.broadcast([c.to_numpy() for c in ends.columns])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *heads = shared.value
        for batch in batches:
            key, edge = batch.column("key").to_numpy(), batch.column("edge").to_numpy() > 0
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            found = known[at] == key if len(known) else np.zeros(len(key), bool)
            out = [batch.column(c) for c in own]
            for c, head in zip(first, heads, strict=True):
                mine = batch.column(c).to_numpy()
                out.append(pa.array(np.where(edge & found, head[at], mine).astype(mine.dtype) if len(known) else mine))
            out += [batch.column(c) for c in counted]
            yield pa.RecordBatch.from_arrays(out, [*own, *first, *counted]).filter(pa.array(~edge | found))

    out = map_arrow(scanned, settle, schema.removesuffix(", edge tinyint"))
    out.scratch_path = scanned.scratch_path  # type: ignore[attr-defined]
    return out


def gathered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, columns as lists) of rows (doc, columns): one row for each doc, its values in one order in all lists.  A doc's rows are held in one task."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last doc, which may go on

        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            doc = table.column(0).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            offsets = pa.array(np.append(begin, len(doc)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(doc[begin]), *lists], ["doc", *columns])

        for batch in batches:
            if not len(batch):
                continue
            doc = batch.column(0).to_numpy()
            at = int(np.searchsorted(doc, doc[-1]))  # the last doc's first row
            if held and (at or held[0].column(0)[0].as_py() != doc[0]):
                yield out([*held, batch.slice(0, at)])
                held = []
            elif at:
                yield out([batch.slice(0, at)])
            held.append(batch.slice(at))
        if held:
            yield out(held)

    ordered = rows.select("doc", *columns).repartition("doc").sortWithinPartitions("doc")
    return map_arrow(ordered, run, ", ".join(["doc long", *(f"{c} array<{kinds[c]}>" for c in columns)]))


def blocks(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """(bucket, data): of each bucket the rows of some columns of eight bytes, byte by byte, so that bytes which are alike stand together."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    rows = np.concatenate([np.ascontiguousarray(c[order].view(np.uint8).reshape(-1, 8).T) for c in columns])
    data = [rows[:, x:y].tobytes() for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "data"])


def held(parts: Iterator[list[np.ndarray]], most: int = BLOCK_ROWS) -> Iterator[list[np.ndarray]]:
    """Lists of columns put together to `most` rows or a few more, as numbers of eight bytes."""
    open_: list[list[np.ndarray]] = []
    n = 0
    for part in parts:
        if len(part[0]):
            open_.append([c.astype(np.int64, copy=False) for c in part])
            n += len(part[0])
        if n >= most:
            yield [np.concatenate(x) for x in zip(*open_, strict=True)]
            open_, n = [], 0
    if open_:
        yield [np.concatenate(x) for x in zip(*open_, strict=True)]


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    return (T.mix(value.view(T.U) + T.U(1)) % T.U(buckets)).astype(np.int32)


def table_bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which Spark has rows by a long, in tables and in joins: its murmur hash with seed 42, modulo their number."""
    u = np.uint32

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << u(by)) | (x >> u(32 - by))

    h = np.full(len(value), 42, u)
    for half in (value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF):
        h = turned(h ^ (turned(half.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    for by, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(by))) * u(times)
    return ((h ^ (h >> u(16))).view(np.int32) % np.int32(buckets)).astype(np.int32)


def _probes(key: np.ndarray, bits: int) -> list[np.ndarray]:
    x = T.mix(key.view(T.U) + T.U(2))
    return [(x >> T.U(by) & T.U(bits - 1)).view(np.int64) for by in (0, 32)]


def key_map(keys: DataFrame, most: int = MAP_BITS) -> Broadcast:
    """A map for may_be() of keys (key), a table or a few: two bits for each key, of eight or more while there are not over `most` in all."""
    bits = min(1 << max(10, (8 * keys.count()).bit_length()), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,) in held([batch.column(0).to_numpy()] for batch in batches):
            at = np.unique(np.concatenate(_probes(key, bits)))
            word, begin = np.unique(at >> 6, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 63), begin))], ["word", "bits"])

    found = map_arrow(keys.select("key"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def may_be(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is among those of a key_map(); a few that are not are taken for some that are."""
    out = np.ones(len(key), bool)
    for at in _probes(key, 64 * len(known)):
        out &= (known[at >> 6] >> (at & 63) & 1).astype(bool)
    return out


def collected(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket and its rows' columns, of batches of blocks() of `width` columns in the order of buckets."""
    parts: list[np.ndarray] = []
    open_ = 0

    def out() -> tuple[int, list[np.ndarray]]:
        flat = np.concatenate(parts, 1)
        return open_, [np.ascontiguousarray(flat[8 * c : 8 * c + 8].T).view(np.int64).ravel() for c in range(width)]

    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if parts and bucket != open_:
                yield out()
                parts = []
            open_ = bucket
            parts.append(np.frombuffer(data.as_buffer(), np.uint8).reshape(8 * width, -1))
    if parts:
        yield out()


def several(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' order by key and doc, and in that order whether several docs have the row's key and how many rows do."""
    order = np.argsort(key)
    ordered, of = key[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(key)])
    size = np.diff(np.append(begin, len(key)))
    shared = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin) if len(begin) else np.zeros(0, bool)
    return order, np.repeat(shared, size), np.repeat(size, size)


def sent(key: np.ndarray, doc: np.ndarray, often: int = OFTEN) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of some are to meet the others of their key, and of each row how many of these rows have its key.

    All but those of keys that several docs and over `often` rows have: of these so many, and the first and the last by doc, which show to the others that several docs have the key.
    """
    order, shared, size = several(key, doc)
    n, out = np.empty(len(key), np.int64), np.ones(len(key), bool)
    n[order] = size
    many = order[shared & (size > often)]
    if len(many):
        by = many[np.lexsort((doc[many], key[many]))]
        edge = np.concatenate([[True], key[by][1:] != key[by][:-1], [True]])
        begin = np.flatnonzero(edge[:-1])
        rank = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
        out[by] = (rank < often) | edge[1:]
    return out, n


def shared_by_doc(rows: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], columns: str, scratch: Scratch | None = None) -> DataFrame:
    """(doc, columns as lists) of the rows whose key another doc has too: what gathered(shared_runs()) gives, but rows are dealt out in blocks and sorted as arrays.

    parts makes lists of the columns key, doc and at of batches of rows; at: what else a row has, as one number.
    columns: names and types of key and at, and of n if wanted: how many rows have the key; of a row that is not sent() as many as were seen beside it.

    With scratch the rows that are to go by doc are written first, and what was shuffled for them goes; the result reads that table, which Scratch.drop() takes away.

    The rows of a bucket of keys, later of docs, meet in one task.  Docs are dealt out as by Spark, for Scratch.keep_dealt().  A key that very many rows have cannot overload it: of those that a task holds at once a few are sent().
    """
    buckets = partitions(rows)  # each task makes a block for each of them
    fields = [x.split() for x in columns.split(", ")]
    types = {"long": np.int64, "int": np.int32}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, at in held(parts(batches)):
            meet, n = sent(key, doc)
            yield blocks(bucket_of(key[meet], buckets), [key[meet], doc[meet], at[meet], np.zeros(int(meet.sum()), np.int64)])
            if not meet.all():  # known to be shared, so they go by doc, apart from the others
                yield blocks(bucket_of(doc[~meet], buckets) + np.int32(buckets), [x[~meet] for x in (key, doc, at, n)])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for bucket, (key, doc, at, n) in collected(batches, 4):
                if bucket >= buckets:
                    yield [key, doc, at, n]
                else:
                    order, shared, size = several(key, doc)
                    take = order[shared]
                    yield [key[take], doc[take], at[take], size[shared]]

        for some in held(found()):
            order = np.lexsort((some[2], some[1]))  # so most bytes of doc and at are alike in a block
            yield blocks(table_bucket(some[1][order], buckets), [c[order] for c in some])

    def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, doc, at, n) in collected(batches, 4):
            order = np.lexsort((at, doc))
            doc = doc[order]
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            edge = np.append(begin, len(doc)).astype(np.int32)
            values = [x[order].astype(types[kind]) for x, (_, kind) in zip((key, at, n), fields, strict=False)]
            for x in range(0, len(begin), 256):
                some = edge[x : x + 257]
                lists = [pa.ListArray.from_arrays(pa.array(some - some[0]), pa.array(v[some[0] : some[-1]])) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(doc[some[:-1]]), *lists], ["doc", *(c for c, _ in fields)])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket")

    met = map_arrow(dealt(map_arrow(rows, keyed, BLOCKS)), settled, BLOCKS)
    if scratch:
        met = scratch.keep(met, "blocks")
    out = map_arrow(dealt(met), by_doc, ", ".join(["doc long", *(f"{c} array<{kind}>" for c, kind in fields)]))
    if scratch:
        out.scratch_path = met.scratch_path  # type: ignore[attr-defined]
    return out


def among(rows: DataFrame, some: DataFrame, column: str = "doc") -> DataFrame:
    """The rows whose number in a column is in that column of some, a written table, and a few others: no row goes to another task for it.

    All tasks get a map of eight bits or more for each of those numbers, of which one is set.
    """
    bits = 1 << max(10, (8 * some.agg(F.approx_count_distinct(column)).first()[0]).bit_length())
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    held = some.select(place.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int))) as _bits"))
    at = rows.withColumn("_at", place).withColumn("_word", F.shiftright("_at", 6))
    found = at.join(F.broadcast(held), "_word").where(F.expr("shiftright(_bits, cast(_at % 64 as int)) & 1 = 1"))
    return found.select(*rows.columns)
