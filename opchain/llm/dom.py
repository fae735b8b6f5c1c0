"""A forgiving HTML tree, kept as flat arrays, and simple tree matching between two of them."""

from __future__ import annotations

import html
import re
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe noembed noframes xmp svg math select".split())
# Elements that end an open element of the same or another kind, by the HTML rules for omitted end tags.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = ENDS_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption legend summary center dir".split())
SCOPES = frozenset("article aside body div footer header html main nav section table td th ul ol dl form blockquote".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


class Tree:
    """Nodes in document order: parent, depth-first; label = tag with its class or id words; own text parts follow in `parts`."""

    __slots__ = ("label", "marks", "parent", "parts", "tag")

    def __init__(self) -> None:
        self.tag: list[str] = ["#root"]
        self.label: list[str] = ["#root"]
        self.marks: list[str] = [""]  # words of class, id, role and the like
        self.parent: list[int] = [-1]
        self.parts: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends


def parse(source: str) -> Tree:
    """The tree of a page.  Unclosed, misnested and cut off markup is read as browsers do in the common cases."""
    tree, open_, at, n = Tree(), [0], 0, len(source)

    def text(a: int, b: int) -> None:
        if a < b:
            tree.parts.append((open_[-1], html.unescape(source[a:b])))

    def close(to: int) -> None:
        while len(open_) > to:
            node = open_.pop()
            if tree.tag[node] in BLOCKS:
                tree.parts.append((open_[-1], None))

    def scope(names: set[str] | frozenset[str], stop: frozenset[str]) -> int:
        for i in range(len(open_) - 1, 0, -1):
            if tree.tag[open_[i]] in names:
                return i
            if tree.tag[open_[i]] in stop:
                break
        return 0

    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            i = next((i for i in range(len(open_) - 1, 0, -1) if tree.tag[open_[i]] == name), 0)
            if i:
                close(i)
            elif name in ("p", "br"):
                tree.parts.append((open_[-1], None))
            continue
        if name in ENDS_P and (i := scope({"p"}, SCOPES)):
            close(i)
        if name in CLOSES and (i := scope(CLOSES[name], frozenset({"ul", "ol", "dl", "table", "select"}))):
            close(i)
        marks = " ".join(x[1].strip("\"'") if x[0].lower() != "hidden" else "hidden" for x in _NAME.findall(m[3]) if x[0].lower() != "aria-hidden" or "true" in x[1].lower()) if m[3].strip() else ""
        node = len(tree.tag)
        tree.tag.append(name)
        tree.marks.append(marks.lower())
        tree.label.append(f"{name}.{marks.lower()}" if marks else name)
        tree.parent.append(open_[-1])
        if name in BLOCKS:
            tree.parts.append((node, None))
        if name == "br":
            tree.parts.append((open_[-1], " "))
        if name in VOID or m[3].rstrip().endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(source, at)
            tree.parts.append((node, source[at : end.start()]))
            at = end.end()
            continue
        open_.append(node)
    close(1)
    return tree


def fold(tree: Tree) -> tuple[tuple[tuple[str, ...], tuple[int, ...]], list[int]]:
    """The tree with neighbouring siblings of one label merged, as (labels, parents), and each node's place in it.

    A list of any length is one entry, so the folded tree stays small however long the page is.
    """
    labels, parents, place = ["#root"], [-1], [0]
    last = {0: -1}  # of each folded node its last child
    for node in range(1, len(tree.label)):
        up = place[tree.parent[node]]
        now = last[up]
        if now < 0 or labels[now] != tree.label[node]:
            now = len(labels)
            labels.append(tree.label[node])
            parents.append(up)
            last[now], last[up] = -1, now
        place.append(now)
    return (tuple(labels), tuple(parents)), place


@lru_cache(maxsize=4096)
def match(a: tuple[tuple[str, ...], tuple[int, ...]], b: tuple[tuple[str, ...], tuple[int, ...]]) -> tuple[tuple[int, int], ...]:
    """Pairs of nodes of a and b that simple tree matching aligns: the most pairs that keep labels, ancestors and order of siblings."""
    children = []
    for _, parents in (a, b):
        kids: list[list[int]] = [[] for _ in parents]
        for i, p in enumerate(parents):
            if p >= 0:
                kids[p].append(i)
        children.append(kids)
    ka, kb = children
    la, lb = a[0], b[0]
    back: dict[tuple[int, int], list[tuple[int, int]]] = {}
    size: dict[tuple[int, int], int] = {}
    todo = [(0, 0, False)]
    while todo:  # children before their parents, without recursion
        x, y, ready = todo.pop()
        if (x, y) in size:
            continue
        if not ready:
            todo.append((x, y, True))
            todo += [(i, j, False) for i in ka[x] for j in kb[y] if la[i] == lb[j]]
            continue
        m, n = len(ka[x]), len(kb[y])
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                p, q = ka[x][i - 1], kb[y][j - 1]
                w = size.get((p, q), 0)
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
        i, j, pairs = m, n, []
        while i and j:
            p, q = ka[x][i - 1], kb[y][j - 1]
            w = size.get((p, q), 0)
            if w and best[i][j] == best[i - 1][j - 1] + w:
                pairs.append((p, q))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        back[x, y] = pairs
        size[x, y] = 1 + best[m][n]
    out, todo2 = [], [(0, 0)]
    while todo2:
        pair = todo2.pop()
        out.append(pair)
        todo2 += back.get(pair, [])
    return tuple(sorted(out))
