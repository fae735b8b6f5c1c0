"""Suffix arrays, Order MinHash and compact windows, against brute force."""

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from opchain.llm import compact_windows as W
from opchain.llm import order_minhash as O
from opchain.llm import suffix_dedup as S
from opchain.llm import text as T

DOCS = "doc_id long, text string, n_chars long, doc string, key string, band int, first int"


def made(seed=3):
    """Texts with a shared passage, exact copies, near copies, self-repeats, short, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, base = text(60), text(300)
    rows = [text(rng.randint(80, 200)) for _ in range(30)]
    for i in (2, 5, 9, 14):
        rows[i][20:20] = passage
    rows[20] = rows[9][:]  # exact copy, with a passage
    for i, edits in ((21, 3), (22, 4), (23, 60)):
        rows[i] = base[:]
        for k in rng.sample(range(300), edits):
            rows[i][k] = word()
    rows[24] = base[:]
    rows[25] = text(70) * 3
    rows[26], rows[27] = text(3), text(3)
    rows[27] = rows[26][:]
    return [" ".join(r) + ("\n" if i % 2 else "") for i, r in enumerate(rows)] + ["", None, "  \n", "one"]


def frame(spark, texts):
    rows = [(i, t, len(t or ""), "x", "y", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[2], 5, None, None, None, None), rows[5]], DOCS).repartition(3)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_passages_match_brute_force(spark):
    texts = made()
    words = [split(t) for t in texts]
    holders = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - S.LEAST + 1):
            holders[tuple(w[k : k + S.LEAST])].add(i)
    want = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - S.LEAST + 1):
            if len(holders[tuple(w[k : k + S.LEAST])]) > 1:
                want[i] |= set(range(k, k + S.LEAST))
    got = defaultdict(set)
    for r in S.find(frame(spark, texts)).collect():
        got[r.doc_id] |= set(range(r.start, r.stop))
        place = words[r.first_doc_id][r.first_start : r.first_start + S.LEAST]
        assert place == words[r.doc_id][r.start : r.start + S.LEAST] and r.first_doc_id <= r.doc_id
    assert got == want and 25 not in got


def test_removal_leaves_one_of_each(spark):
    texts = made()
    docs = frame(spark, texts)
    out = S.remove(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    seen = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            assert r.n_chars == len(r.text or "")
            w = split(r.text)
            for k in range(len(w) - S.LEAST + 1):
                seen[tuple(w[k : k + S.LEAST])].add(r.doc_id)
    assert all(len(x) == 1 for x in seen.values())
    ids = {r.doc_id for r in rows}
    assert 20 not in ids and {0, 1, 2, 26, 27, 30, 31, 32, 33, None} <= ids
    by = {r.doc_id: r.text for r in rows}
    assert by[2] == texts[2] and by[0] == texts[0] and by[31] is None
    assert S.remove(docs.limit(0)).count() == 0 and S.find(docs.limit(0)).count() == 0


def shingles(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_classes_match_brute_force(spark):
    texts = made()
    s = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (texts[a] or "") == (texts[b] or "") or s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                x, y = up[a], up[b]
                up = [min(x, y) if v in (x, y) else v for v in up]
    got = {r.doc_id: r.class_id for r in O.find(frame(spark, texts)).collect()}
    assert got == dict(enumerate(up))
    assert got[21] == got[22] == got[24] == 21 and got[23] == 23 and got[20] == 9
    kept = O.remove_near(frame(spark, texts))
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x) == [None, *sorted(set(up))]
    assert O.find(frame(spark, texts).limit(0)).count() == 0 and O.remove_near(frame(spark, texts).limit(0)).count() == 0


def test_alignment():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 1 << 60, 200).astype(T.U)
    assert O.alignment(a, a) == 1 and O.alignment(a, a[:0]) == 0
    b = np.concatenate([a[:100], rng.integers(1, 1 << 60, 10).astype(T.U), a[100:]])
    assert O.alignment(a, b) == pytest.approx(200 / 210)
    assert O.alignment(a, np.concatenate([a[150:], a[:150]])) < 0.8  # the same labels in another order
    i = np.arange(6)
    assert O.chained(i, np.array([0, 5, 1, 2, 4, 3])) == 4 and O.chained(i[:0], i[:0]) == 0


def test_many_near_copies_of_one_text(spark):
    """A hot group: every copy differs a little, and all meet in one class."""
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(10**6) for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(150):
        w = base[:]
        w[rng.randrange(200)] = "e%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in O.find(docs).collect()} == {0}


def test_group_around_the_last_text(spark):
    """Every copy is like the text of the highest doc_id only: it settles with the least copy and must still meet the others."""
    rng = random.Random(11)
    base = ["w%d" % rng.randrange(10**6) for _ in range(200)]
    texts = []
    for _ in range(60):
        w = base[:]
        shift = rng.randrange(40)
        for k in range(4):
            w[6 + shift + 45 * k] = "e%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    docs = spark.createDataFrame([*enumerate(texts), (999, " ".join(base))], "doc_id long, text string")
    assert {r.class_id for r in O.find(docs).collect()} == {0}


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, least = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        v = rng.integers(1, 12, n).astype(T.U)
        v[-4:] = 0
        m = max(n - 4, 0)
        got = sorted(zip(*(x.tolist() for x in W.compact_windows(v, np.arange(n) + least <= m, least)), strict=True))
        want = []
        for c in range(m):
            lo = hi = c
            while lo > 0 and v[lo - 1] > v[c]:
                lo -= 1
            while hi + 1 < m and v[hi + 1] >= v[c]:
                hi += 1
            if hi - lo + 1 >= least:
                want.append((c, lo, hi))
        assert got == want


def test_passages_at_every_place():
    """A passage held twice is given twice, and a phrase that stands earlier in one text does not cut it."""
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(1, 1 << 60, n).astype(T.U)
    p, x, y = new(60), new(100), new(100)
    twice = np.concatenate([x[:50], p, x[50:], p])
    assert [c[:4] for c in W.chains(twice, np.concatenate([y, p]))] == [(50, 114, 100, 164), (160, 224, 100, 164)]
    assert [c[:4] for c in W.chains(np.concatenate([y, p]), twice)] == [(100, 164, 50, 114), (100, 164, 160, 224)]
    assert [c[:4] for c in W.chains(np.concatenate([p[30:31], x, p]), np.concatenate([y, p]))] == [(101, 165, 100, 164)]
    same = np.full(3000, p[0])
    assert W.chains(same, same) == [(0, 3004, 0, 3004, 1.0)] and W.chains(x, y) == [] and W.chains(x[:0], y) == []


def test_passages_beyond_the_first_texts(spark):
    """A stock phrase in earlier texts hides no pair of later ones, and copies of a later original all meet it."""
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(10**6)
    text = lambda n: [word() for _ in range(n)]
    phrase, tail, base = text(36), text(30), text(120)
    rows = [text(60) + phrase + text(60) for _ in range(12)] + [text(60) + phrase + tail + text(60) for _ in range(2)]
    for _ in range(12):
        w = base[:]
        shift = rng.randrange(30)
        for k in range(2):
            w[6 + shift + 45 * k] = word()
        rows.append(text(20) + w + text(20))
    rows.append(text(20) + base + text(20))
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.match_doc_id) for r in W.find(docs).collect()}
    assert (13, 12) in got and {x for pair in got for x in pair} == set(range(12, 27))
    assert {(26, i) for i in range(14, 26)} <= got


def classes_of_links(rows):
    """{(doc_id, start, stop): least (doc_id, start) of its class} of passages that find() gave, by joining overlapping ones and both ends of each."""
    spans = defaultdict(set)
    for r in rows:
        spans[r.doc_id].add((r.start, r.stop))
        spans[r.match_doc_id].add((r.match_start, r.match_stop))
    places = {}
    for doc, x in spans.items():
        for s, e in sorted(x):
            last = places.setdefault(doc, [])
            if last and s < last[-1][1]:
                last[-1][1] = max(last[-1][1], e)
            else:
                last.append([s, e])
    place = lambda doc, at: next((doc, s) for s, e in places[doc] if s <= at < e)
    cls = {(doc, s): (doc, s) for doc, x in places.items() for s, _ in x}
    for r in rows:
        a, b = cls[place(r.doc_id, r.start)], cls[place(r.match_doc_id, r.match_start)]
        cls = {k: min(a, b) if v in (a, b) else v for k, v in cls.items()}
    return {(doc, s, e): cls[doc, s] for doc, x in places.items() for s, e in x}


def test_marks_leave_room_for_what_is_common():
    """No two texts with NEED runs of one about a place in the other are ruled out, with repeated runs too."""
    rng = np.random.default_rng(3)
    for kinds in (4, 30, 10**6):
        for _ in range(40):
            key = rng.integers(-(2**63), 2**63, kinds)[rng.integers(0, kinds, 150)]
            other = np.concatenate([rng.integers(-(2**63), 2**63, 20), rng.permutation(key)])
            pos, theirs = np.arange(150), np.arange(170)
            row = int(rng.integers(0, 150))
            near = np.abs(pos - row) <= W.LEAST
            mark, least = W.around(key, pos, np.array([row]), np.array([0]), W.LEAST)
            for there in np.flatnonzero(other == key[row]).tolist():
                around = np.isin(key, other[np.abs(theirs - there) <= 2 * W.LEAST])
                if (near & around).sum() >= W.NEED:
                    held, _ = W.around(other, theirs, np.array([there]), np.array([0]), 2 * W.LEAST)
                    assert sum(int(x & y & (2**64 - 1)).bit_count() for x, y in zip(mark[0].tolist(), held[0].tolist(), strict=True)) >= least[0]
    assert W.around(key[:10], pos[:10], np.array([3]), np.array([0]), W.LEAST)[1][0] == W.BITS + 1


def test_texts_with_one_phrase_in_common_are_not_compared(spark):
    """30 texts share the nine runs of a phrase, and each all its runs with one other: 15 pairs, not 435."""
    rng = np.random.default_rng(4)
    phrase = rng.integers(-(2**63), 2**63, 9).tolist()
    rows = []
    for two in range(15):
        keys = [*rng.integers(-(2**63), 2**63, 25).tolist(), *phrase, *rng.integers(-(2**63), 2**63, 26).tolist()]
        rows += [(doc, keys, list(range(60)), [2] * 25 + [1] * 9 + [2] * 26) for doc in (2 * two, 2 * two + 1)]
    rows.append((1000, [7], [0], [1]))
    spots = spark.createDataFrame(rows, "doc long, key array<long>, pos array<int>, n array<int>")
    left = spark.createDataFrame([(d, 30) for d in range(30)], "doc long, pos int")
    owners = spark.createDataFrame([(d, 1000) for d in range(30)], "doc long, owner long")
    got = {(r.doc, r.owner) for r in W.beyond(left, owners, spots).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(15)}


def test_passage_classes_give_each_place_once(spark):
    """A row for every place, the first document's too, however many others hold the passage; classes are those of all pairs."""
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randrange(10**6)
    text = lambda n: [word() for _ in range(n)]
    passage, other, alike = text(70), text(60), text(120)
    rows = [text(40) + passage + text(40) for _ in range(30)]
    rows[3] += other + text(20)
    rows += [text(10) + other for _ in range(4)]
    for k in range(8):
        w = alike[:]
        w[7 + 3 * k] = w[60 + 2 * k] = word()
        rows.append(text(30) + w + text(9 + k))
    rows += [rows[36][:], rows[36][:], text(90)]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = W.classes(docs).collect()
    links = W.find(docs).where("doc_id not in (42, 43)").collect()
    own = {(r.doc_id, r.start, r.stop): (r.class_doc_id, r.class_start) for r in got if r.copy_of is None}
    want = classes_of_links(links)
    assert {k[:2]: v for k, v in own.items()} == {k[:2]: v for k, v in want.items()}
    assert {(i, 40, 110) for i in range(30)} <= set(own) and len({own[i, 40, 110] for i in range(30)}) == 1
    assert {d for d, _, _ in own} == set(range(42)) and len(own) == 43
    n = len(rows[36])
    assert sorted(tuple(r) for r in got if r.copy_of is not None) == [(i, 0, n, 36, 0, 36) for i in (36, 42, 43)]
    assert W.classes(docs.limit(0)).count() == 0


def test_passage_classes_match_those_of_all_pairs(spark):
    """The same classes as by all verified pairs, with near copies, self-repeats, short, empty and null texts."""
    texts = made()
    docs = frame(spark, texts)
    got = {(r.doc_id, r.start): (r.class_doc_id, r.class_start) for r in W.classes(docs).collect() if r.copy_of is None}
    want = classes_of_links(W.find(docs).collect())
    assert got == {k[:2]: v for k, v in want.items()} and {d for d, _ in got} == {2, 5, 9, 14, 20, 21, 22, 24}


def test_joined_spans():
    at = lambda x: np.array(x)
    assert W._classes_at(at([0, 5, 6, 40, 90]), at([5, 40]), at([11, 60]), at([7, 8])).tolist() == [-1, 7, 7, 8, -1]
    assert W._classes_at(at([3]), at([]), at([]), at([])).tolist() == [-1]


def test_passages_of_texts_with_copies_leave_no_large_tables(spark):
    """Copies beyond one change nothing but their own rows, short texts alone are no error, and what no result reads is dropped."""
    from opchain.plans.scratch import shared_folder

    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(10**6)
    base = [word() for _ in range(90)]
    near = [*base[:40], word(), *base[40:]]
    texts = [" ".join(x) for x in (base, near, base, base, base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("windows-*"))
    got = sorted(tuple(r)[:6] for r in W.find(docs).collect())
    assert got == [(1, 0, 91, 0, 0, 90), *((i, 0, 90, 0, 0, 90) for i in (2, 3, 4))]
    (mine,) = set(folder.glob("windows-*")) - before
    assert {p.name[4:] for p in mine.iterdir()} <= {"marked", "copies", "repeated", "owners", "pairs", "found"}
    assert W.find(spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id long, text string").coalesce(1)).count() == 0


@pytest.mark.parametrize("batch", [1, 4, 10_000])
def test_gathered_in_batches_of_any_size(spark, batch):
    from opchain.llm.passages import gathered

    rng = random.Random(batch)
    rows = [(rng.randrange(1 << 40), rng.choice([5, 5, 5, rng.randrange(-9, 9)]), p) for p in range(120)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        got = gathered(spark.createDataFrame(rows, "key long, doc long, pos int"), ["key", "pos"]).collect()
    finally:
        spark.conf.set(name, before)
    assert len(got) == len({d for _, d, _ in rows}) and sorted((k, r.doc, p) for r in got for k, p in zip(r.key, r.pos, strict=True)) == sorted(rows)


def test_near_duplicate_passages(spark):
    texts = made()
    words = [split(t) for t in texts]
    rows = W.find(frame(spark, texts)).collect()
    for r in rows:
        a, b = ({tuple(words[d][i : i + 5]) for i in range(s, e - 4)} for d, s, e in ((r.doc_id, r.start, r.stop), (r.match_doc_id, r.match_start, r.match_stop)))
        assert r.stop - r.start >= 50 and len(a & b) >= 0.8 * len(a | b)
    caught = {r.doc_id for r in rows} | {r.match_doc_id for r in rows}
    assert {2, 5, 9, 14, 20, 21, 22, 24} <= caught and not caught & {0, 1, 3, 4, 25, 26, 27, 30, 31, 32, 33}
    assert W.find(frame(spark, texts).limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(1)
    long = " ".join("w%d" % rng.randrange(10**7) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "x y " + long[1000:]), (3, "short")], "doc_id long, text string")
    assert {r.doc_id for r in S.find(docs).collect()} == {1, 2}
    assert {r.doc_id: r.class_id for r in O.find(docs).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_shared_runs_in_batches_of_any_size(spark, batch):
    from opchain.llm.passages import shared_runs
    from opchain.plans.scratch import Scratch

    rng = random.Random(batch)
    rows = {(7, rng.randrange(40), p) for p in range(150)}  # a common key, which spans partitions
    rows |= {(9, 3, p) for p in range(40)}  # a key of one doc alone, over several batches
    rows |= {(rng.randrange(-60, 60), rng.randrange(8), rng.randrange(5)) for _ in range(160)}
    by_key = defaultdict(list)
    for key, doc, pos in rows:
        by_key[key].append((doc, pos))
    want = {(k, d, p, *min(v)) for k, v in by_key.items() if len({d for d, _ in v}) > 1 for d, p in v}
    name, scratch = "spark.sql.execution.arrow.maxRecordsPerBatch", Scratch(spark, "t")
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        table = scratch.keep(spark.createDataFrame(sorted(rows), "key long, doc long, pos int"), "rows")
        got = shared_runs(table, scratch).collect()
        plain = shared_runs(table, scratch, owners=False, sizes=True).collect()
    finally:
        spark.conf.set(name, before)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r)[:3] for r in plain} == {w[:3] for w in want} and len(plain) == len(want)
    assert all(1 <= r.n <= len(by_key[r.key]) for r in plain)


def test_rows_dealt_in_blocks_match_brute_force(spark):
    from opchain.llm import passages as P

    rng = random.Random(5)
    rows = {(7, rng.randrange(40), p) for p in range(300)}  # a key that OFTEN rows have and more
    rows |= {(9, 3, p) for p in range(40)}  # a key of one doc alone
    rows |= {(rng.randrange(-60, 60), rng.randrange(8), rng.randrange(5)) for _ in range(160)}
    by_key = defaultdict(list)
    for key, doc, pos in rows:
        by_key[key].append((doc, pos))
    want = {(k, d, p) for k, v in by_key.items() if len({d for d, _ in v}) > 1 for d, p in v}
    table = spark.createDataFrame(sorted(rows), "key long, doc long, pos int").repartition(3)
    parts = lambda batches: ([c.to_numpy() for c in b.columns] for b in batches)
    got = P.shared_by_doc(table, parts, "key long, pos int, n int").collect()
    assert len({r.doc for r in got}) == len(got)
    flat = [(k, r.doc, p, n) for r in got for k, p, n in zip(r.key, r.pos, r.n, strict=True)]
    assert len(flat) == len(want) and {x[:3] for x in flat} == want
    assert all(1 <= n <= len(by_key[k]) for k, _, _, n in flat)
    lists = spark.createDataFrame([(r.doc, r.key) for r in got], "doc long, key array<long>")
    some = [7, 8, 1000]
    held = {r.doc: set(r.wanted) for r in W.holding(lists, spark.createDataFrame([(k,) for k in some], "key long")).collect()}
    assert held == {r.doc: set(r.key) & set(some) for r in got if set(r.key) & set(some)}


def test_a_key_of_many_rows_is_not_sent_to_one_task():
    from opchain.llm import passages as P

    key, doc = np.array([5] * 1000 + [6] * 1000 + [7, 8]), np.array([*range(1000), *[3] * 1000, 1, 1])
    sent, n = P.sent(key, doc)
    assert sent[key == 5].sum() <= P.OFTEN + 2 and {0, 999} <= set(doc[sent & (key == 5)].tolist())
    assert sent[key != 5].all()  # nobody knows yet whether another doc has them
    assert n.tolist() == [1000] * 2000 + [1, 1]


def test_texts_are_not_dealt_out_again_for_each_join(spark, tmp_path):
    """A scan for some documents moves no text, and a table that was dealt out by a column is joined by it as it lies."""
    from opchain.llm import passages as P
    from opchain.plans.scratch import Scratch

    scratch = Scratch(spark, "t")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc long, text string")
    some = scratch.keep(spark.createDataFrame([(i,) for i in range(0, 2000, 40)], "doc long"), "some")
    found = P.among(docs, some)
    ids = {r.doc for r in found.collect()}
    assert set(range(0, 2000, 40)) <= ids and len(ids) < 600
    texts = scratch.keep_dealt(docs, "texts", "doc", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = some.join(texts, "doc")
        assert {(r.doc, r.text) for r in joined.collect()} == {(i, f"text {i}") for i in range(0, 2000, 40)}
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1
    scratch.drop(texts, some)
    assert not Path(texts.scratch_path.removeprefix("file://")).exists() and not spark.catalog.tableExists(texts.scratch_table)


def test_only_runs_that_may_be_wanted_go_to_other_tasks(spark):
    """A map of keys passes all of them and few others; texts without two functions' windows over one run are left out; Spark's buckets are known."""
    from opchain.llm import passages as P
    from opchain.plans.scratch import Scratch

    rng = np.random.default_rng(3)
    some, others = rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(-(1 << 62), 1 << 62, 20000)
    known = P.key_map(spark.createDataFrame([(int(k),) for k in some], "key long").repartition(3)).value
    assert P.may_be(some, known).all() and P.may_be(others, known).mean() < 0.1
    at = lambda *wins: W._packed(*(np.array(x) for x in zip(*wins, strict=True))).tolist()
    rows = [(1, at((5, 0, 5, 60), (70, 1, 4, 50))), (2, at((5, 0, 5, 60), (70, 1, 5, 50))), (3, at((5, 2, 5, 60), (9, 2, 5, 60)))]
    found = W.deep(spark.createDataFrame([(d, [0] * len(x), x) for d, x in rows], "doc long, key array<long>, at array<long>"))
    assert [r.doc for r in found.collect()] == [2]
    docs = spark.createDataFrame([(int(k), "x") for k in others[:500]] + [(-1, "x"), (0, "x")], "doc long, text string")
    got = docs.selectExpr("doc", "pmod(hash(doc), 7) as b").toArrow()
    assert P.table_bucket(got.column(0).to_numpy(), 7).tolist() == got.column(1).to_pylist()
    scratch = Scratch(spark, "t")
    table = scratch.keep_dealt(docs.coalesce(1), "docs", "doc", 7, dealt=True)
    assert sorted(table.collect()) == sorted(docs.collect()) and len(table.inputFiles()) == 7
    scratch.drop(table)


def test_passages_of_compressed_texts_are_the_same(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") * rng.randrange(1, 9) + "é%d" % rng.randrange(900) for _ in range(150)]
    texts = [(0, " ".join(base)), (1, " ".join([*base[:60], "x", *base[60:]])), (2, ""), (3, None), (4, " ".join(base[20:90]))]
    texts = spark.createDataFrame(texts, "doc long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a)], "doc long, owner long")
    packed = W.squeezed(texts)
    assert dict(packed.dtypes)["text"] == "binary"
    want = sorted(W.verify(pairs, texts).collect())
    assert len(want) >= 3 and sorted(W.verify(pairs, packed).collect()) == want
