"""Decision lists over text statistics, learned by sequential covering.

Statistics of whole texts come from one vectorised pass.  On labelled texts, rules for bad text are
grown one condition at a time (FOIL's gain), pruned on texts held back, and the texts that a rule
catches are removed before the next is grown.  The list becomes one Spark conditional expression.

Nulls, empty and odd input: a null text has no words, lines or symbols; so has an empty one.
Labels without doc_id or quality, or other than 0 and 1, are ignored; of several labels of one doc_id the
least counts, and of several texts the one of the least counts.  Without labels of both classes the list is empty and rejects nothing.  Repeated rows
get equal verdicts, an empty table gives no rows, and columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from opchain.llm import text as T
from opchain.plans.arrow import map_arrow

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOLS, _UPPER, _DIGITS, _MARKS = _class("#*$%&|<>"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("!?.,;:")


def _per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a column."""
    parts: list[list[np.ndarray]] = []
    for a, b, w in T.words(column):
        d, off, n = w.data, w.offsets, b - a
        word_byte = ~T.SPACES[d]
        begin, end = T.runs(d != 10, off)
        has = np.zeros(len(d) + 1, np.int64)
        np.cumsum(word_byte, out=has[1:])
        full = has[end] > has[begin]
        begin, end = begin[full], end[full]
        line_row = np.searchsorted(off, begin, "right") - 1
        again = T.occurrences(line_row, T.segment(d, off, begin, end)) > 0
        triple, whole = w.grams(3)
        at = np.flatnonzero(whole)
        key = T.mix(triple[at] + T.mix(w.row[at].astype(T.U)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
        repeated = np.zeros(len(w.hash) + 2, bool)
        for k in range(3):
            repeated[twice + k] = True
        parts.append([
            w.counts,
            _per_row(word_byte & ((d & 0xC0) != 0x80), off),
            _per_row(_SYMBOLS[d], off),
            np.bincount(line_row[again], minlength=n),
            np.bincount(w.row[repeated[: len(w.hash)]], minlength=n),
            np.bincount(line_row, minlength=n),
            _per_row(_UPPER[d], off),
            _per_row(_DIGITS[d], off),
            _per_row(_MARKS[d], off),
        ])
    return {name: np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i, name in enumerate(COUNTS)}


def measure(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with COUNTS of its column text, each under `prefix` and its name."""
    at = docs.columns.index("text")
    schema = St.StructType([*docs.schema.fields, *(St.StructField(prefix + c, St.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c]) for c in COUNTS)], schema.names)

    return map_arrow(docs, run, schema)


def features(c: dict[str, Column] | dict[str, np.ndarray]) -> dict:
    """The figures that conditions are about, from COUNTS, as Spark columns or as arrays."""
    top = (lambda x: F.greatest(x, F.lit(1))) if isinstance(c["n_words"], Column) else (lambda x: np.maximum(x, 1))
    words, chars = top(c["n_words"]), top(c["word_chars"])
    return {
        "words": c["n_words"] * 1.0,
        "mean_word_chars": c["word_chars"] / words,
        "symbols_per_word": c["n_symbols"] / words,
        "dup_line_share": c["n_dup_lines"] / top(c["n_lines"]),
        "repeat_word_share": c["n_repeat_words"] / words,
        "words_per_line": c["n_words"] / top(c["n_lines"]),
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
        "marks_per_word": c["n_marks"] / words,
    }


def base_failed(c: dict[str, Column]) -> Column:
    """The fixed rule: under 50 words, or over half of the words in repeated three-word windows."""
    return (c["n_words"] < 50) | (F.lit(100) * c["n_repeat_words"] > F.lit(50) * c["n_words"])


@dataclass(frozen=True)
class Rule:
    """A text is bad if it meets every (feature, above, threshold): over the threshold, or else at most it."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, values: dict) -> Column | np.ndarray:
        out = None
        for name, above, limit in self.conditions:
            one = values[name] > limit if above else values[name] <= limit
            out = one if out is None else out & one
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, depth: int) -> list[tuple[str, bool, float]]:
    inside, conditions = np.ones(len(bad), bool), []
    while len(conditions) < depth:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0 or not n0:
            break
        best = (0.0, None, None)
        for name, v in x.items():
            for limit in np.unique(np.quantile(v[inside], np.linspace(0, 1, cuts + 1)[:-1])):
                for above in (True, False):
                    now = inside & ((v > limit) if above else (v <= limit))
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                    further = above and best[1] and best[1][:2] == (name, True)  # of equally good limits the one next to the bad texts
                    if gain > best[0] + 1e-9 or further and gain > best[0] - 1e-9:
                        best = (gain, (name, above, float(limit)), now)
        if best[1] is None:
            break
        name, above, limit = best[1]
        v = x[name][inside]
        if (v > limit).any() and (v <= limit).any():  # half way between the neighbouring values
            limit = float((v[v <= limit].max() + v[v > limit].min()) / 2)
        conditions.append((name, above, limit))
        inside = best[2]
    return conditions


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most: int = 12, cuts: int = 40, depth: int = 4) -> list[Rule]:
    """Sequential covering.  Each rule is grown on two thirds of the texts left and pruned to the conditions of the best Laplace precision on the last third.

    It stays if `precision` of what it catches in the third held back is bad, some text at least, and its Laplace precision over all texts left
    is `precision` too.  The thirds take turns, and the list ends when no turn gives a rule: a kind of bad text with few examples needs only some in each third.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    turn = failed = 0
    while len(rules) < most and failed < 3 and (left & bad).any():
        back = np.arange(len(bad)) % 3 == turn % 3
        turn += 1
        grow, prune = left & ~back, left & back
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], cuts, depth)
        best: tuple[float, Rule | None] = (0.0, None)
        for k in range(1, len(conditions) + 1):
            rule = Rule(tuple(conditions[:k]))
            (p, n), (p_all, n_all) = ((int((rule.holds(x) & m & bad).sum()), int((rule.holds(x) & m & ~bad).sum())) for m in (prune, left))
            worth = (p + 1) / (p + n + 2)
            if p and p >= precision * (p + n) and p_all + 1 >= precision * (p_all + n_all + 2) and worth > best[0] + 1e-12:
                best = (worth, rule)
        if best[1] is None:
            failed += 1
            continue
        failed = 0
        rules.append(best[1])
        left &= ~best[1].holds(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000) -> list[Rule]:
    """Learns from at most `per_class` labelled texts of each class, those first by a hash of doc_id; statistics are of their whole texts."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ranked = marked.withColumn("at", F.xxhash64("doc_id"))
    sample = [r for q in (0, 1) for r in ranked.where(F.col("quality") == q).orderBy("at", "doc_id").limit(per_class).collect()]
    if len({r.quality for r in sample}) < 2:
        return []
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.quality, r["at"]) for r in sample], "doc_id long, quality int, at long")
    measured = measure(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = measured.groupBy("doc_id", "at", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "at", "quality", "c.*").collect()  # one of each document
    rows.sort(key=lambda r: (r["at"], r.doc_id))
    if len({r.quality for r in rows}) < 2:
        return []
    found = features({c: np.array([r[c] for r in rows], float) for c in COUNTS})
    return learn(found, np.array([r.quality == 0 for r in rows]))


def kept(c: dict[str, Column], rules: Sequence[Rule]) -> Column:
    """The verdict: the fixed rule, then each rule in its order, and otherwise true."""
    out, values = F.when(base_failed(c), F.lit(False)), features(c)
    for rule in rules:
        out = out.when(rule.holds(values), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) of every row."""
    found = measure(docs.select("doc_id", "text"))
    c = {x: F.col(x) for x in COUNTS}
    return found.select("doc_id", *COUNTS, base_failed(c).alias("base_failed"), kept(c, rules).alias("kept"))


def keep(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows of docs with a true verdict, all their columns unchanged."""
    prefix = "_rule_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = "_" + prefix
    found = measure(docs, prefix)
    return found.where(kept({x: F.col(prefix + x) for x in COUNTS}, rules)).drop(*(prefix + x for x in COUNTS))
