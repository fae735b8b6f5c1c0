"""Quality scores from compression with a dictionary of good and one of bad text.

Two zstandard dictionaries are built from labelled texts.  A text is cut into blocks, each block is
compressed once with either dictionary, and the difference of the summed sizes, divided by the
text's bytes, tells which kind of text it resembles.  A logistic curve fitted on labelled texts
that are in neither dictionary turns the difference into a probability.

Nulls, empty and odd input: a null text counts as empty; an empty text has difference 0 and gets
the curve's value there.  Labels without doc_id or quality, or other than 0 and 1, are ignored;
of several labels of one doc_id the least counts.  With no labelled text of a class every score is the share of
good labels (0.5 without any).  Extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opchain.plans.arrow import map_arrow

BLOCK, LEVEL = 2048, 3


@dataclass(frozen=True)
class Model:
    """Dictionaries as bytes (empty: none could be built) and the logistic curve 1 / (1 + exp(-(slope * z + shift)))."""

    good: bytes
    bad: bytes
    slope: float
    shift: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            extra = {}
            if raw:
                extra["dict_data"] = zstandard.ZstdCompressionDict(raw)
                extra["dict_data"].precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra))
        return out

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))


def difference(raw: memoryview | bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(compressed with bad - compressed with good) / size, over all blocks of a text."""
    n = len(raw)
    if not n:
        return 0.0
    total = 0
    for at in range(0, n, BLOCK):
        part = raw[at : at + BLOCK]
        total += len(bad.compress(part)) - len(good.compress(part))
    return total / n


def _dictionary(texts: list[bytes], size: int) -> bytes:
    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    parts = [p for p in parts if len(p) >= 16]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:  # too little or too uniform text for a trained one
        return b""


def _blocks(texts: DataFrame, most: int) -> DataFrame:
    """(doc_id, n, block) of at most `most` blocks of each text, those first by a hash of doc_id and their number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                first = sorted(range(-(-len(raw) // BLOCK)), key=lambda k: (zlib.crc32(b"%d:%d" % (d, k)), k))[:most]
                out += [(d, k, raw[k * BLOCK : (k + 1) * BLOCK]) for k in first]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "n", "block"])

    return map_arrow(texts, run, "doc_id long, n int, block binary")


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of a lightly regularised logistic fit, by Newton's method on the scaled difference."""
    scale = float(np.std(z)) or 1.0
    x = np.stack([z / scale, np.ones_like(z)], 1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        move = np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = 4000, chars: int = 16384, dictionary: int = 65536) -> Model:
    """Fits on at most `per_class` labelled texts of each class: those first by a hash of doc_id.

    Half of them make the dictionaries, from at most `chars` bytes of each, in blocks taken by a hash from the whole text;
    the other half, read whole by score(), the curve.  usable: a condition on doc_id that a label must meet.
    """
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked if usable is None else marked.where(usable)
    ranked = marked.withColumn("at", F.xxhash64("doc_id"))
    sample = [r for q in (0, 1) for r in ranked.where(F.col("quality") == q).orderBy("at", "doc_id").limit(per_class).collect()]
    good = sum(r.quality for r in sample)
    share = good / len(sample) if sample else 0.5
    flat = Model(b"", b"", 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < good < len(sample):
        return flat
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.quality, r["at"]) for r in sample], "doc_id long, quality int, at long")
    there = sorted((r["at"], r.doc_id, r.quality) for r in docs.select("doc_id").join(F.broadcast(chosen), "doc_id").distinct().collect())
    half, rest = ([x for q in (0, 1) for i, x in enumerate([x for x in there if x[2] == q]) if i % 2 == k] for k in (0, 1))
    if len({x[2] for x in half}) < 2 or len({x[2] for x in rest}) < 2:
        return flat

    def texts(of: list[tuple[int, int, int]]) -> DataFrame:
        return docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame([(x[1],) for x in of], "doc_id long")), "doc_id")

    found = sorted({(r.doc_id, r.n, bytes(r.block)) for r in _blocks(texts(half), max(chars // BLOCK, 1)).toLocalIterator()})
    quality = {x[1]: x[2] for x in there}
    model = Model(*(_dictionary([block for d, _, block in found if quality[d] == q], dictionary) for q in (1, 0)), 0.0, 0.0)
    if not model.good or not model.bad:
        return flat
    scored = sorted({(r.doc_id, r.difference) for r in score(texts(rest), model).select("doc_id", "difference").toLocalIterator()})
    z, y = np.array([x[1] for x in scored]), np.array([quality[x[0]] for x in scored], float)
    # the sample is balanced: weigh the shift back to the share that all usable labels have
    slope, shift = logistic(z, y)
    counts = {r.quality: r["count"] for r in marked.groupBy("quality").count().collect()}
    inside = float(y.mean())
    prior = counts[1] / (counts[0] + counts[1])
    return Model(model.good, model.bad, slope, shift + float(np.log(prior / (1 - prior)) - np.log(inside / (1 - inside))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, difference, score) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        for batch in batches:
            z = np.array([difference(memoryview(x.as_buffer()) if x.is_valid else b"", good, bad) for x in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z), pa.array(model.score(z))], ["doc_id", "difference", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, difference double, score double")
