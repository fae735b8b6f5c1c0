"""Exact passages that documents share, from a sparse suffix array.

Of each text's suffixes only those are kept that begin at a minimiser: the word run of GRAM words with the least
hash in a window.  Any two occurrences of a passage of `least` words choose the same suffixes in it,
since least = window + GRAM - 1.  The kept suffixes are sorted by their first words' hash, and neighbours are
compared; suffixes that no other document shares fall away.  From the others the matches are
extended to the left and right: every start from which a passage of `least` words holds the shared
suffix's words is itself sorted and compared, which decides exactly; adjoining passages are joined.

Words are runs of other characters than [\\x20\\x09-\\x0D].  A passage counts if two different texts
hold it; repetition within one text alone does not.  Its first place is that in the least doc_id.

Nulls, empty and odd input: null, empty and short texts hold no passage; rows without doc_id are left out; rows that share
doc_id and text are one document, and of rows that share only doc_id each text is read under that doc_id.  Documents with equal texts
share the whole text if it has `least` words.  Extra columns are ignored, and kept by `remove`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from opchain.llm import text as T
from opchain.llm.passages import distinct_texts, shared_runs
from opchain.plans.arrow import map_arrow
from opchain.plans.scratch import Scratch

LEAST, GRAM = 50, 16


def sparse_suffixes(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, n_words, at, hash) of every document: where its kept suffixes begin, and the hash of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in T.words(batch.column(1)):
                value, _ = w.grams(gram)
                n = len(w.hash)
                at = T.minimisers(value, np.arange(n) + least <= w.stop, least - gram + 1)
                count = np.bincount(w.row[at], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), T.keys(batch.column(1).slice(a, b - a)), pa.array(w.counts, pa.int32()), T.lists((at - w.first[w.row[at]]).astype(np.int32), count, pa.int32()), T.lists(T.signed(value[at]), count, pa.int64())],
                    ["doc_id", "text_key", "n_words", "at", "hash"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, text_key binary, n_words int, at array<int>, hash array<long>")


def _starts(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(key, doc, pos): the hash of every passage of `least` words that holds one of the runs at `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            for a, b, w in T.words(batch.column(1)):
                part = marks.slice(a, b - a)
                at = part.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b - a), part.value_lengths().to_numpy(zero_copy_only=False))
                at = at + w.first[row]
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, np.maximum(at - (least - gram), w.first[row]), 1)
                np.add.at(edge, at + 1, -1)
                value, whole = w.grams(least)
                take = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & whole)
                doc = batch.column(0).slice(a, b - a).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(value[take])), pa.array(doc[w.row[take]]), pa.array((take - w.first[w.row[take]]).astype(np.int32))], ["key", "doc", "pos"])

    return map_arrow(texts.select("doc_id", "text", "marks"), run, "key long, doc long, pos int")


def _joined(least: int):
    """Merges the starts of a document into spans of words, with the first place of each span's first passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, hits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = hits.values
                pos, owner, owner_pos, later = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                order = np.argsort(pos, kind="stable")
                pos, owner, owner_pos, later = pos[order], owner[order], owner_pos[order], later[order].astype(bool)
                for kind in (False, True):  # all shared passages, and those of which an earlier place exists
                    p, o, q = (pos, owner, owner_pos) if not kind else (pos[later], owner[later], owner_pos[later])
                    if not len(p):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], p[1:] > p[:-1] + least]))
                    last = np.append(first[1:], len(p)) - 1
                    out += [(doc, int(p[i]), int(p[j]) + least, int(o[i]), int(q[i]), kind) for i, j in zip(first, last, strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], ["doc", "start", "stop", "owner", "owner_start", "later"])

    return run


def passages(docs: DataFrame, scratch: Scratch, least: int = LEAST, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Spans (doc, start, stop, owner, owner_start, later) of words of distinct texts, and (doc_id, first, n_words) of every document.

    later = false: spans that another text shares; later = true: those parts of them that stand in a lesser doc_id as well.
    `first` is the least doc_id with the document's text; spans are given for that one alone.
    """
    kept = scratch.keep(sparse_suffixes(docs, least, gram).where("doc_id is not null"), "suffixes")
    copies = distinct_texts(kept.select("doc_id", "text_key"))
    members = scratch.keep(copies.join(kept.groupBy("doc_id").agg(F.max("n_words").alias("n_words")), "doc_id"), "members")
    single = members.where("doc_id = first").select("doc_id")
    suffixes = kept.join(single, "doc_id").select(F.col("doc_id").alias("doc"), F.explode(F.arrays_zip("hash", "at")).alias("s")).select(F.col("s.hash").alias("key"), "doc", F.col("s.at").alias("pos"))
    ordered = scratch.keep(suffixes, "ordered")
    shared = shared_runs(ordered, scratch)
    marks = shared.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("marks"))
    texts = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("doc"))
    starts = scratch.keep(_starts(texts, least, gram), "starts")
    scratch.drop(kept, ordered, shared)
    hits = shared_runs(starts, scratch)
    by_doc = hits.groupBy("doc").agg(F.collect_list(F.struct("pos", "owner", "owner_pos", (F.col("owner") < F.col("doc")).alias("later"))).alias("hits"))
    spans = scratch.keep(map_arrow(by_doc, _joined(least), "doc long, start int, stop int, owner long, owner_start int, later boolean"), "spans")
    scratch.drop(starts, hits)
    return spans, members


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, stop, n_words, first_doc_id, first_start, copy_of): each document's spans of words that other documents hold too.

    first_doc_id and first_start say where the span's first words stand first.  A document whose whole text another has
    is one span, with copy_of naming the least doc_id of that text; the spans of the text itself are given under that doc_id.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    spans, members = passages(docs, scratch, least)
    none = F.lit(None).cast("long")
    own = spans.where("not later").select(F.col("doc").alias("doc_id"), "start", "stop", F.col("owner").alias("first_doc_id"), F.col("owner_start").alias("first_start"), none.alias("copy_of"))
    zero = F.lit(0)
    copied = members.where(f"doc_id <> first and n_words >= {least}")
    whole = copied.select("doc_id", zero.alias("start"), F.col("n_words").alias("stop"), F.col("first").alias("first_doc_id"), zero.alias("first_start"), F.col("first").alias("copy_of"))
    heads = copied.groupBy("first").agg(F.max("n_words").alias("n"))
    heads = heads.select(F.col("first").alias("doc_id"), zero.alias("start"), F.col("n").alias("stop"), F.col("first").alias("first_doc_id"), zero.alias("first_start"), none.alias("copy_of"))
    return own.unionByName(whole).unionByName(heads).distinct().withColumn("n_words", F.col("stop") - F.col("start"))


def cut(column: pa.Array, starts: pa.Array, stops: pa.Array) -> list[str | None]:
    """Each text without its word spans [start, stop) and the white space after each of them."""
    out: list[str | None] = []
    for a, _, w in T.words(column):
        for r in range(len(w.first) - 1):
            if starts[a + r].as_py() is None or not column[a + r].is_valid:
                out.append(column[a + r].as_py())
                continue
            f, n = int(w.first[r]), int(w.first[r + 1])
            lo, hi = int(w.offsets[r]), int(w.offsets[r + 1])
            kept, at = [], lo
            for s, e in sorted(zip(starts[a + r].as_py(), stops[a + r].as_py(), strict=True)):
                s, e = f + s, min(f + e, n)
                kept.append(w.data[at : w.start[s]].tobytes())
                at = int(w.start[e]) if e < n else hi
            kept.append(w.data[at:hi].tobytes())
            out.append(b"".join(kept).decode())
    return out


def remove(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, all columns kept, with shared passages left only where they stand first, by doc_id; n_chars follows the text if there is one.

    Copies of a text other than the first, and documents of which only white space is left, go; documents without a text or a doc_id stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    spans, members = passages(docs, scratch, least)
    later = spans.where("later").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"))
    copies = members.where(f"doc_id <> first and n_words >= {least}").select("doc_id", F.lit(True).alias("is_copy"))
    plan = members.join(later, F.col("doc_id") == F.col("doc"), "left").join(copies, "doc_id", "left")
    plan = plan.where("s is not null or is_copy").select(F.col("doc_id").alias("_sfx_doc"), F.col("s.start").alias("_sfx_start"), F.col("s.stop").alias("_sfx_stop"), F.coalesce("is_copy", F.lit(False)).alias("_sfx_copy"))
    joined = docs.join(plan, docs["doc_id"] == F.col("_sfx_doc"), "left").where("_sfx_copy is null or not _sfx_copy").drop("_sfx_doc", "_sfx_copy")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops = batch.column(len(names)), batch.column(len(names) + 1)
            texts = cut(batch.column(at), starts, stops)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                old = columns[i].to_pylist()
                columns[i] = pa.array([len(t) if s.is_valid and t is not None else o for t, s, o in zip(texts, starts, old, strict=True)], columns[i].type)
            keep = pa.array([not (s.is_valid and t is not None and not t.strip(" \t\n\v\f\r")) for t, s in zip(texts, starts, strict=True)])
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return map_arrow(joined, run, St.StructType(docs.schema.fields))
