"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a folded DOM tree.  Every page of a host is aligned by simple tree matching with the host's
reference, the first page of the commonest shape among those with text.  Over all pages of the host it is counted how often each node of that tree was
found, how often with the same text, and with how many words: nodes whose text varies are slots, and the smallest container that holds most of the slots' words is
where the host's pages keep their article.  Template is looked for in the pages' unfolded trees, the reference has no part in it: a node's text is
template if it stands under the same labels in CONSTANT of the host's pages of different text that have text there, two at least.  A page's text is what its aligned container holds, without
template and without parts that are marked as menus, adverts, forms, comments and the like.  On hosts of fewer than PAGES pages
of different text a page whose template would be over half of its words keeps it, as they may be versions of one article.

Nulls, empty and odd input: null or empty html gives empty text; pages without a host are one group; a host with a
single page, or pages that are all alike, has no template, and its container is found from its words alone; a page that
does not fit its host's wrapper is read like a single page.  Every page row gives one row, repeated
rows too; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opchain.llm import dom
from opchain.plans.arrow import map_arrow
from opchain.plans.scratch import Scratch

SKIPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object embed canvas svg math dialog menu audio video map noembed noframes".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|side-?bars?|cookies?|consent|notices?|alerts?|pop-?ups?|modals?|"
    r"newsletters?|subscribe|subscription|share|sharing|social|related|recommend(?:ed|ations)?|comments?|replies|respond|disqus|discussion|footer|header|masthead|widgets?|pagination|pager|hidden|complementary|contentinfo|search|login|signup|toolbar)(?=$|[\s_-])"
)
CONTAINERS = frozenset("#root html body main article section div td tr tbody table center".split())
BROADCAST_BYTES = 32 << 20  # of wrappers up to which they are sent to every executor
SHARE, CONSTANT, PAGES = 0.6, 0.9, 4


def _skipped(tag: str, marks: str, inside_article: bool) -> bool:
    return tag in SKIPPED or tag == "header" and not inside_article or bool(marks and tag not in ("html", "body", "article", "main") and MARKED.search(marks))


def _labels_skipped(labels: tuple[str, ...], parents: tuple[int, ...]) -> list[bool]:
    """Of each folded node whether it or a node above it is set apart by its tag or its class, id or role."""
    out, article = [], []
    for label, up in zip(labels, parents, strict=True):
        tag, _, marks = label.partition(".")
        article.append(tag in ("article", "main") or up >= 0 and article[up])
        out.append(up >= 0 and (out[up] or _skipped(tag, marks, article[up])))
    return out


def container(labels: tuple[str, ...], parents: tuple[int, ...], weight: list[float]) -> int:
    """The deepest container that still holds most of the weight that no skipped part holds."""
    skipped = _labels_skipped(labels, parents)
    total = [0.0 if s else w for s, w in zip(skipped, weight, strict=True)]
    for i in range(len(total) - 1, 0, -1):
        total[parents[i]] += total[i]
    named = [i for i in range(len(labels)) if labels[i].partition(".")[0] in ("article", "main") and not skipped[i]]
    at = max(named, key=lambda i: (total[i], -i), default=0)
    if not named or total[at] < 0.25 * total[0]:
        at = 0
    while True:
        inner = [i for i in range(at + 1, len(labels)) if parents[i] == at and not skipped[i] and labels[i].partition(".")[0] in CONTAINERS]
        best = max(inner, key=lambda i: total[i], default=-1)
        if best < 0 or total[best] <= 0 or total[best] < (SHARE if labels[at].partition(".")[0] not in ("article", "main") else 1.0) * total[at]:
            return at
        at = best


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _texts(tree: dom.Tree, place: list[int], n: int) -> list[str]:
    """Own text of each folded node, white space squeezed."""
    own: list[list[str]] = [[] for _ in range(n)]
    for node, t in tree.parts:
        if t:
            own[place[node]].append(t)
    return [" ".join("".join(x).split()) for x in own]


def _lines(tree: dom.Tree) -> list[tuple[int, int, int]]:
    """(node, path, text) of every single node with own text: hashes of the labels down to it, and of its text."""
    path = [0]
    for label, up in zip(tree.label[1:], tree.parent[1:], strict=True):
        path.append(zlib.crc32(label.encode(), path[up]))
    own = _texts(tree, list(range(len(tree.label))), len(tree.label))
    return [(i, path[i], zlib.crc32(t.encode())) for i, t in enumerate(own) if t]


def trees(pages: DataFrame) -> DataFrame:
    """(host, page_id, shape, hashes, words, lines) of every page; lines: its distinct pairs of path and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = dom.parse(source or "")
                (labels, parents), place = dom.fold(tree)
                own = _texts(tree, place, len(labels))
                out.append((_host(url), json.dumps([labels, parents]), [zlib.crc32(t.encode()) for t in own], [len(t.split()) for t in own], sorted({_key(p, t) for _, p, t in _lines(tree)})))
            host, shape, hashes, words, lines = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), batch.column(0), pa.array(shape, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(lines, pa.list_(pa.int64()))], ["host", "page_id", "shape", "hashes", "words", "lines"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "host string, page_id long, shape string, hashes array<long>, words array<int>, lines array<long>")


def _key(path: int, text: int) -> int:
    """Path and text in one signed number, the path above."""
    return (path - (1 << 31) << 32) | text


def template(found: DataFrame) -> DataFrame:
    """(host, pages, lines): of every host how many pages of different text it has, and the lines constant among those that have the path.

    Two pages of one text are one page, so copies of an article do not make it template.
    """
    pages = found.select("host", "lines", F.xxhash64("lines").alias("page")).dropDuplicates(["host", "page"])
    paths = F.array_distinct(F.transform("lines", lambda x: F.shiftright(x, 32)))
    having = pages.select("host", F.explode(paths).alias("path")).groupBy("host", "path").agg(F.count("*").alias("n")).where("n >= 2")
    lines = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("same")).where("same >= 2")
    constant = lines.withColumn("path", F.shiftright("line", 32)).join(having, ["host", "path"]).where(F.col("same") >= CONSTANT * F.col("n"))
    listed = constant.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return pages.where(F.size("lines") > 0).groupBy("host").agg(F.count("*").alias("pages")).join(listed, "host", "left")


def _load(shape: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    labels, parents = json.loads(shape)
    return tuple(labels), tuple(parents)


def align(found: DataFrame, first: DataFrame) -> DataFrame:
    """(host, node, n, same, words): of each node of a host's reference, in how many pages it was found, with equal text, and its words in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, int], list[int]] = {}
            for host, shape, hashes, words, ref, ref_hashes in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for a, b in dom.match(_load(ref), _load(shape)):
                    row = out.setdefault((host, a), [0, 0, 0])
                    row[0] += 1
                    row[1] += ref_hashes[a] == hashes[b]
                    row[2] += words[b]
            rows = [(*k, *v) for k, v in out.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "node", "n", "same", "words"])

    both = found.join(first, "host").select("host", "shape", "hashes", "words", "ref", "ref_hashes")
    counted = map_arrow(both, run, "host string, node int, n long, same long, words long")
    return counted.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("words").alias("words"))


def wrapper(shape: str, counts: list[tuple[int, int, int, int]], pages: int, lines: list[int]) -> str:
    """A host's wrapper from its reference's shape, the (node, n, same, words) of its nodes, and its template: shape, container, template and pages."""
    labels, parents = _load(shape)
    n, same, words = ([0] * len(labels) for _ in range(3))
    for node, a, b, c in counts:
        n[node], same[node], words[node] = a, b, c
    varies = [w * (1 - s / k if k and n[0] >= 2 else 1.0) for w, s, k in zip(words, same, n, strict=True)]
    skipped = _labels_skipped(labels, parents)
    alike = not any(v > 0 and not s for v, s in zip(varies, skipped, strict=True))  # nothing varies: the pages are copies
    root = container(labels, parents, [float(w) for w in words] if alike else varies)
    return json.dumps([shape, root, lines, pages])


def _below(parents: tuple[int, ...], root: int) -> list[bool]:
    out: list[bool] = []
    for i, up in enumerate(parents):
        out.append(i == root or up >= 0 and out[up])
    return out


def induce(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper) of every host."""
    found = scratch.keep(trees(pages), "trees")
    some = found.where(F.aggregate("words", F.lit(0), lambda s, x: s + x) > 0)
    shapes = some.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "hashes")).alias("f"))
    first = shapes.groupBy("host").agg(F.min(F.struct(-F.col("n"), "f", "shape")).alias("x")).select("host", F.col("x.shape").alias("ref"), F.col("x.f.hashes").alias("ref_hashes"))
    first = scratch.keep(first, "first")
    counted = align(found, first).groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "words")).alias("counts"))  # as many as a folded tree has nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wrapper(s, [tuple(x.values()) for x in c], n, t or []) for s, c, n, t in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "wrapper"])

    out = scratch.keep(map_arrow(first.join(counted, "host").join(template(found), "host").select("host", "ref", "counts", "pages", "lines"), run, "host string, wrapper string"), "wrappers")
    scratch.drop(found, first)
    return out


@lru_cache(maxsize=64)
def _wrapper(text: str) -> tuple[str, int, frozenset[int], int]:
    shape, root, lines, pages = json.loads(text)
    return shape, root, frozenset(lines), pages


def extract(source: str, host_wrapper: str | None) -> str:
    """A page's main text: its blocks, one to a line."""
    if not source:
        return ""
    tree = dom.parse(source)
    shape, place = dom.fold(tree)
    labels, parents = shape
    root, constant, pages = -1, set(), 0
    if host_wrapper:
        ref, at, known, pages = _wrapper(host_wrapper)
        pairs = dict(dom.match(_load(ref), shape))
        root = pairs.get(at, -1) if at else -1  # #root tells nothing: the page's own words decide
        constant = {i for i, p, t in _lines(tree) if _key(p, t) in known} if known else set()
    skipped = _labels_skipped(labels, parents)
    words = [len(t.split()) for t in _texts(tree, place, len(labels))]
    if root >= 0:
        inside = _below(parents, root)
        if not any(w and i and not s for w, i, s in zip(words, inside, skipped, strict=True)):
            root = -1
    if root < 0:
        root = container(labels, parents, [float(w) for w in words])
        inside = _below(parents, root)
    takes = [i and not s for i, s in zip(inside, skipped, strict=True)]
    if pages < PAGES and constant:  # so few pages may share much of their article
        own = [len(t.split()) if takes[place[i]] else 0 for i, t in enumerate(_texts(tree, list(range(len(place))), len(place)))]
        if 2 * sum(own[i] for i in constant) > sum(own):
            constant = set()
    blocks, now = [], []
    for node, t in [*tree.parts, (0, None)]:
        if t is None:
            if now and (block := " ".join("".join(now).split())):
                blocks.append(block)
            now = []
        elif takes[place[node]] and node not in constant:
            now.append(t)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    wrappers = induce(pages, scratch)
    small = (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_host(u) for u in batch.column(1).to_pylist()], pa.string())], ["page_id", "url", "html", "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "", w) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    named = map_arrow(pages.select("page_id", "url", "html"), hosts, "page_id long, url string, html string, host string")
    joined = named.join(F.broadcast(wrappers) if small else wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return map_arrow(joined, run, "page_id long, url string, text string, n_chars long")
