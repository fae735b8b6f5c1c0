"""Passages of benchmark items in documents, by a prefix-filtered join in DataFrame operations only.

An item's windows are its runs of 13 words, or all its words if it has fewer.  A window occurs only
where all its words do, so one word suffices as its prefix: the one that is rarest in all documents.
Document words are joined with prefix words; a hit gives the one place where the window can begin, which must
lie within the document (the length and positional bounds), and there the words are compared.

Nulls, empty and odd input: null or empty texts have no words; such a document has no hits and is
not contaminated, such an item has no windows.  Items without item_id are ignored, rows of one
item_id count as one item.  Every document row gives one row, repeated rows and null doc_ids too.
Other columns of either table are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000  # windows (each under 1 kB) up to which the item side is sent to every executor


def words(text: Column) -> Column:
    """Words of a text in lower case (A-Z only); null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(plain, SEPARATORS), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, n, items): each different window, its number of words, and the item_ids that have it."""
    w = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.lit(size), F.size("w")))
    each = w.select("item_id", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("p"))
    each = each.select("item_id", "n", F.slice("w", F.col("p"), F.col("n")).alias("window"))
    return each.groupBy("window", "n").agg(F.collect_set("item_id").alias("items"))


def _small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def prefixes(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """windows with their rarest word, by how often each occurs in all docs, and where it first stands in them."""
    maybe = F.broadcast if small else (lambda x: x)
    used = windows.select("window", F.explode(F.array_distinct("window")).alias("word"))
    vocabulary = used.select("word").distinct()
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).join(maybe(vocabulary), "word").groupBy("word").count()
    rank = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word")
    rarest = used.join(maybe(counts), "word", "left").groupBy("window").agg(F.min(rank).alias("rarest"))
    found = windows.join(rarest, "window").where("rarest.count > 0")
    word = F.col("rarest.word")
    return found.select("window", "n", "items", word.alias("prefix"), (F.array_position("window", word) - 1).cast("int").alias("before"))


def occurrences(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(doc_id, mark, start, n, items) of every window in every document; start counts words from 0, mark is the text's hash."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    if small:
        at = keyed.select("doc_id", "mark", "w", F.posexplode("w").alias("p", "prefix"))
        found = at.join(F.broadcast(windows), "prefix")
    else:  # find the documents' prefix words without their texts first
        slim = keyed.select("doc_id", "mark", F.posexplode("w").alias("p", "prefix"))
        hits = slim.join(windows.select("prefix").distinct(), "prefix", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("p", "prefix")).alias("hits"))
        same = keyed.alias("k").join(hits.alias("h"), F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("k.mark") == F.col("h.mark")))
        at = same.select("k.doc_id", "k.mark", "w", F.explode("hits").alias("hit")).select("doc_id", "mark", "hit.*", F.slice("w", F.greatest(F.col("hit.p") + 2 - WINDOW, F.lit(1)), 2 * WINDOW).alias("w"), (F.greatest(F.col("hit.p") + 1 - WINDOW, F.lit(0))).alias("shift"))
        found = at.join(windows, "prefix").withColumn("p", F.col("p") - F.col("shift"))
    start = F.col("p") - F.col("before")
    inside = found.where((start >= 0) & (start + F.col("n") <= F.size("w")))
    shift = F.col("shift") if not small else F.lit(0)
    return inside.where(F.slice("w", start + 1, F.col("n")) == F.col("window")).select("doc_id", "mark", (start + shift).alias("start"), "n", "items")


def covered(spans: Column) -> Column:
    """How many positions a sorted array of (start, n) covers."""
    zero = F.struct(F.lit(0).alias("till"), F.lit(0).cast("long").alias("total"))

    def add(a: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        new = F.greatest(F.lit(0), end - F.greatest(x["start"], a["till"]))
        return F.struct(F.greatest(a["till"], end).alias("till"), (a["total"] + new).alias("total"))

    return F.aggregate(spans, zero, add, lambda a: a["total"])


def decontaminate(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, mark) of every row of docs.

    contaminated: some word is hit, and share * n_hit >= n_words.
    """
    windows = item_windows(items)
    small = _small(windows, BROADCAST_ROWS)
    hits = occurrences(docs, prefixes(windows, docs, small), small)
    by_doc = hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("items").alias("items"))
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string")))
    found = by_doc.select(F.col("doc_id").alias("hit_doc"), F.col("mark").alias("hit_mark"), covered(F.array_sort("spans")).alias("n_hit"), ids.alias("ids"))
    every = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("mark") == F.col("hit_mark")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "mark",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, all their columns unchanged."""
    bad = decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("_bad_doc"), F.col("mark").alias("_bad_mark")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_bad_doc")) & (F.xxhash64(docs["text"]) == F.col("_bad_mark"))
    return docs.join(bad, same, "left_anti")


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
s as (select item_id, w, least(13, len(w)) as n from i where len(w) > 0),
v as (select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') as k from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as p from s)),
sizes as (select distinct n from v),
g as (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
h as (select g.doc_id, g.p, g.n, v.item_id from g join v on g.n = v.n and g.k = v.k),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from (select distinct doc_id, p, n from h)) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit on d.doc_id = hit.doc_id left join it on d.doc_id = it.doc_id
"""
