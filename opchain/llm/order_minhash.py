"""Near-duplicate documents by Order MinHash and banded alignment.

A document's five-word runs are labelled with how often they have occurred in it before, so labels are unique.  For each of
BANDS * ROWS hash functions the two labels of least hash, in the order in which they stand in the text, make
one entry of its sketch; equal entries are likely for texts of high edit similarity.  ROWS entries make a band, and
documents with an equal band are candidates.  A pair is verified by alignment: equal labels that lie within
the diagonal band outside of which no match of the wanted similarity can lie are chained in order, and similarity is the
number of chained labels over that of all labels of both texts, the chained ones counted once.

Which pairs of a bucket are compared rests on a bound.  Over all documents that share a bucket it is counted how many of a document's
labels another one has too: no two documents have more labels in common than the lesser of these counts, so most pairs
that share a line or a passage, or that are each an edit away from a third text, are out without being compared.
In each bucket the document of which the largest share is held by others leads, and all others are compared with it; then those in another
class with more leaders, the best of each part of the bucket; at the end all pairs of different classes that no bound excludes and that were not
compared before are compared, in blocks of BLOCK by BLOCK documents.  Pairs of one class are never compared: they change nothing.  A pair is
aligned if AGREE of its sketch entries are equal (in their last byte): at the wanted similarity 64 in 100 are expected, and 4 pairs in 10,000 fall below.
Classes are the connected components of the verified pairs.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case.  Texts of fewer than five words have
one label, all their words; texts without words are near to nothing but equal texts.

Nulls, empty and odd input: a null text counts as empty; rows without doc_id get no class (and all stay in
`remove_near`); rows with one doc_id are one document, whose texts all count as its own.  Equal texts have one class.
Extra columns are ignored, and kept by `remove_near`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opchain.llm import text as T
from opchain.llm.passages import distinct_texts, shared_runs
from opchain.operators.components import connected_components
from opchain.plans.arrow import map_arrow
from opchain.plans.scratch import Scratch

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 3
AGREE = 32  # of BANDS * ROWS entries
BLOCK = 500  # documents of a bucket on either side of one join key
LEADERS = (1, 16)  # of a bucket in each round, before all pairs that are left


def labels(w: T.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unique labels of the k-word runs of each row, in text order, and each row's first label (and their number at the end)."""
    value, whole = w.grams(k)
    for short in range(1, k):
        rows = np.flatnonzero(w.counts == short)
        if len(rows):
            at = w.first[rows]
            value[at] = w.grams(short)[0][at] + T.U(short)
            whole[at] = True
    take = np.flatnonzero(whole)
    row = w.row[take]
    return T.mix(value[take] + T.mix(T.occurrences(row, value[take]).astype(T.U) + T.U(1))), np.searchsorted(row, np.arange(len(w.first)))


def sketch(label: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes, and the last byte of every entry, of each row that has labels."""
    full = np.flatnonzero(np.diff(first))
    begin = first[:-1][full]
    out, last = np.zeros((len(full), bands), T.U), np.zeros((len(full), bands * rows), np.int8)
    if not len(full):
        return out, last
    spot = np.arange(len(label), dtype=T.U)
    low = T.U((1 << int(len(label)).bit_length()) - 1)
    single = np.diff(first)[full] == 1
    seeds = T.mix(np.arange(1, 2 * bands * rows + 1, dtype=T.U) * T.U(0x9E3779B97F4A7C15))
    for j in range(bands * rows):
        v = (((label ^ seeds[2 * j]) * (seeds[2 * j + 1] | T.U(1))) & ~low) | spot
        a = (np.minimum.reduceat(v, begin) & low).astype(np.int64)
        v[a] = ~T.U(0)
        b = np.where(single, a, (np.minimum.reduceat(v, begin) & low).astype(np.int64) if not single.all() else a)
        entry = T.mix(label[np.minimum(a, b)] + T.mix(label[np.maximum(a, b)] + T.U(j)))
        out[:, j // rows] = T.mix(out[:, j // rows] + entry)
        last[:, j] = entry.astype(np.uint8).view(np.int8)
    return out, last


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, bands, entries) of every row; n: its labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in T.words(batch.column(1), T.NON_ALNUM, lower=True):
                label, first = labels(w)
                found, last = sketch(label, first)
                some = (np.diff(first) > 0).astype(np.int64)
                arrays = [batch.column(0).slice(a, b - a), T.keys(batch.column(1).slice(a, b - a)), pa.array(np.diff(first), pa.int64()), T.lists(T.signed(found.ravel()), some * BANDS, pa.int64()), T.lists(last.ravel(), some * BANDS * ROWS, pa.int8())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n", "bands", "entries"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, text_key binary, n long, bands array<long>, entries array<tinyint>")


def label_rows(texts: DataFrame) -> DataFrame:
    """(key, doc, pos) of every label of texts (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for a, b, w in T.words(batch.column(1), T.NON_ALNUM, lower=True):
                label, first = labels(w)
                row = np.repeat(np.arange(b - a), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(label)), pa.array(docs[a + row]), pa.array((np.arange(len(label)) - first[row]).astype(np.int32))], ["key", "doc", "pos"])

    return map_arrow(texts.select("doc", "text"), run, "key long, doc long, pos int")


def chained(i: np.ndarray, j: np.ndarray) -> int:
    """Length of the longest chain of matches (i ascending) in which j ascends."""
    if not len(j) or (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two label sequences in order; below `similarity` it may come out lower than it is."""
    both = len(a) + len(b)
    if not both:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < similarity * (both - len(i)):
        return len(i) / (both - len(i)) if len(i) else 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    near = np.abs(i - j) <= both * (1 - similarity) / (1 + similarity) + 1
    c = chained(i[near], j[near])
    return c / (both - c)


def labels_of(column: pa.Array, separators: np.ndarray = T.NON_ALNUM, lower: bool = True) -> list[np.ndarray]:
    """Labels of each row's text; equal texts are read once."""
    coded = column.fill_null("").dictionary_encode()
    rows: list[np.ndarray] = []
    for _, _, w in T.words(coded.dictionary, separators, lower):
        label, begin = labels(w)
        rows += np.split(label, begin[1:-1])
    return [rows[k] for k in coded.indices.to_pylist()]


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts, from (doc, text), are similar enough.  Each text is shuffled once for each side, whatever the number of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sides = [labels_of(part.column(c)) for c in (2, 3)]
                keep = [alignment(x, y, similarity) >= similarity for x, y in zip(*sides, strict=True)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    b = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return map_arrow(joined, run, "a long, b long")


def _classes(rows: DataFrame, found: DataFrame | None, column: str) -> DataFrame:
    """rows with the class of `column` as cls: its component, or itself."""
    if found is None:
        return rows.withColumn("cls", F.col(column))
    names = found.select(F.col("vertex").alias(column), "component")
    return rows.join(names, column, "left").withColumn("cls", F.coalesce("component", column)).drop("component")


def _tasks(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df in no more partitions than `rows` rows need, so that a small round costs few tasks."""
    return df.coalesce(max(1, -(-rows // each)))


def _bounded(a: str, b: str, similarity: float = SIMILARITY) -> Column:
    """Whether columns n_a, s_a and n_b, s_b leave room for the similarity: at most the lesser of s_a and s_b labels are common.  A count below 0 bounds nothing."""
    common = F.least("s_" + a, "s_" + b)
    return (common < 0) | (common >= F.lit(similarity - 1e-9) * (F.col("n_" + a) + F.col("n_" + b) - common))


def _agree(a: str = "a", b: str = "b") -> Column:
    """Whether AGREE sketch entries are equal; true without a sketch."""
    equal = F.aggregate(F.zip_with("entries_" + a, "entries_" + b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce(equal >= AGREE, F.lit(True))


def _side(rows: DataFrame, name: str, *columns: Column) -> DataFrame:
    """Columns of rows (band, doc, cls, n, s, ...) under the name of one side of a pair."""
    return rows.select("band", *columns, F.col("doc").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in rows.columns if c in ("cls", "n", "s", "all", "entries")))


def _led(rows: DataFrame, leaders: int) -> DataFrame:
    """(a, b) of rows (band, doc, cls, n, s): each document of a bucket with the bucket's leaders of other classes, one for each of so many parts of it."""
    order = F.struct((F.col("s") / F.col("n")).alias("share"), (-F.col("doc")).alias("doc"))
    heads = rows.groupBy("band", F.pmod(F.xxhash64("doc"), F.lit(leaders)).alias("part")).agg(F.max_by(F.struct("doc", "cls", "n", "s"), order).alias("x")).select("band", "x.*")
    near = _side(rows, "a").join(_side(heads, "b"), "band").where((F.col("cls_a") != F.col("cls_b")) & _bounded("a", "b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between(rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """(a, b) of rows (band, doc, cls, n, s): the agreeing pairs of a bucket whose classes differ, in the first bucket that both are in.

    A large bucket is dealt in blocks.  sketched: (doc, all, entries), all bands and the sketch of a document.
    """
    mixed = rows.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo < hi")
    dealt = rows.join(mixed.select("band", "blocks"), "band").join(sketched, "doc", "left").withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = _side(dealt, "a", F.col("mine").alias("i"), other.alias("j"))
    two = _side(dealt, "b", other.alias("i"), F.col("mine").alias("j"))
    first = F.coalesce(F.array_min(F.filter(F.zip_with("all_a", "all_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())) == F.col("band"), F.lit(True))
    near = one.join(two, ["band", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("cls_a") != F.col("cls_b")) & _bounded("a", "b") & first & _agree())
    return near.select("a", "b").distinct()


def _agreeing(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) of which AGREE sketch entries are equal, and those without a sketch."""
    one, two = (sketched.select(F.col("doc").alias(x), F.col("entries").alias("entries_" + x)) for x in ("a", "b"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where(_agree()).select("a", "b")


def near_classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, first, class_id) of every document, and (doc_id, n) of those on several rows."""
    rows = scratch.keep(sketches(docs).where("doc_id is not null"), "sketches")
    members = scratch.keep(distinct_texts(rows.select("doc_id", "text_key")), "members")
    again = scratch.keep(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("text_key").alias("texts")).where("n > 1"), "repeated")
    repeated, several = again.select("doc_id", "n"), again.where("texts > 1").select(F.col("doc_id").alias("doc"), "texts")
    single = members.where("doc_id = first").select(F.col("doc_id").alias("doc"))
    banded = rows.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("band")).join(single, "doc", "left_semi").distinct()
    banded = scratch.keep(banded, "bands")
    shared = banded.groupBy("band").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("band")
    open_ = scratch.keep(banded.join(shared, "band").select("band", "doc"), "open")
    scratch.drop(banded)
    wanted = open_.select("doc").distinct()
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted.hint("merge"), "doc", "left_semi")
    texts = scratch.keep(texts if repeated.isEmpty() else texts.distinct(), "texts")
    entries = scratch.keep(rows.select(F.col("doc_id").alias("doc"), "n", F.col("bands").alias("all"), "entries").join(wanted, "doc", "left_semi"), "entries")
    scratch.drop(rows)
    labelled = scratch.keep(label_rows(texts), "labels")
    shared_labels = shared_runs(labelled, scratch, owners=False)
    held = scratch.keep(shared_labels.groupBy("doc").agg(F.count("*").alias("s")), "held")
    scratch.drop(labelled, shared_labels)
    sizes = entries.groupBy("doc").agg(F.max("n").alias("n")).join(held, "doc", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    if not several.isEmpty():  # documents of several texts have no bound and no sketch
        sizes = sizes.join(several, "doc", "left").withColumn("s", F.when(F.col("texts") > 1, -1).otherwise(F.col("s"))).drop("texts")
    alive = sizes.where(f"s < 0 or s >= {SIMILARITY - 1e-9} * n")
    open_ = scratch.keep(open_.join(alive, "doc").select("band", "doc", "n", "s"), "alive")
    entries = scratch.keep(entries.select("doc", "all", "entries").join(alive.where("s >= 0").select("doc"), "doc", "left_semi").distinct(), "entries")
    links, tested, found = None, None, None
    for leaders in (*LEADERS, None):
        now = _classes(open_, found, "doc").select("band", "doc", "cls", "n", "s")
        pairs = _led(now, leaders) if leaders else _between(now, entries)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(_agreeing(pairs, entries) if leaders else pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        good = scratch.keep(_tasks(verify(pairs, texts).distinct(), pairs.count(), 500), "links")
        if not good.isEmpty():
            links = good if links is None else links.unionByName(good)
            found = connected_components(links, scratch)
    out = _classes(members, found, "first").select("doc_id", "first", F.col("cls").alias("class_id"))
    return out, repeated


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of) of every document: class_id is the least doc_id of its class, copy_of the least with its very text."""
    out, _ = near_classes(docs, Scratch(docs.sparkSession, "order-minhash"))
    return out.select("doc_id", "class_id", F.col("first").alias("copy_of"))


def remove_near(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least doc_id, with all columns of docs; one row of it if there are several."""
    scratch = Scratch(docs.sparkSession, "order-minhash")
    out, repeated = near_classes(docs, scratch)
    stay = scratch.keep(out.where("doc_id = class_id").select(F.col("doc_id").alias("_near_doc")), "stay")
    kept = docs.join(stay.hint("merge"), docs["doc_id"] == F.col("_near_doc"), "left_semi")  # the list grows with the input: the same join at every size
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
