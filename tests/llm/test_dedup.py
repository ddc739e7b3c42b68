"""Exact, near and substring deduplication against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tidelode.llm import ngram_join, suffix_dedup
from tidelode.llm.components import components
from tidelode.llm.exact_dedup import exact_dedup, without_copies
from tidelode.llm.ngram_join import ngram_join as join
from tidelode.llm.suffix_dedup import multikey_sort, repeated_spans
from tidelode.llm.workspace import Workspace

SPACES = r"[\x20\x09-\x0D]+"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- exact


def exact_plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACES, " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return Counter(out), len(groups)


@pytest.mark.parametrize("how", [{}, {"bits": 8}, {"batch": {"maxFilesPerTrigger": 1}, "stores": 3}])
def test_exact(spark, edge, edge_rows, how):
    want, groups = exact_plain(edge_rows)
    got = exact_dedup(spark, edge, **how).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups


def test_exact_collision_of_the_whole_digest(spark, monkeypatch):
    """Texts whose full digests are equal stay apart by their bytes."""
    from pyspark.sql import functions as F

    sha2 = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, bits: sha2(F.substring(c, 1, 1), bits))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "b"), (5, "c"), (6, "c")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark, docs).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True), 5: (5, 2, True), 6: (5, 2, False)}


def test_exact_stage(spark, edge, edge_rows):
    left = without_copies(spark, edge)
    assert left.columns == edge.columns
    texts = [re.sub(SPACES, " ", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == exact_plain(edge_rows)[1]


def test_exact_empty(spark, edge):
    assert exact_dedup(spark, edge.limit(0)).count() == 0
    assert without_copies(spark, edge.limit(0)).count() == 0


# ---- near


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def near_plain(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            s = shingles(t)
            sets[i] = min(sets.get(i, s), s, key=len) if i in sets else s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near(spark, edge, edge_rows):
    rows = join(spark, edge).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == near_plain(edge_rows)
    assert all(r.component_id is None for r in rows if r.doc_id is None)


@pytest.mark.parametrize(("hot", "sketch"), [(50_000, 4), (6, 4), (6, 0)])
def test_near_families(spark, monkeypatch, hot, sketch):
    """Families larger than a tile's pairs, and boilerplate that unlike documents share."""
    import random

    rng = random.Random(11)
    boiler = [f"b{k}" for k in range(60)]
    rows, k = [], 0
    for f in range(3):
        base = [f"f{f}w{x}" for x in range(150)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    for _ in range(80):
        rows.append((k, " ".join(boiler + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))])))
        k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name, value in (("PAIRED", 4), ("FREQUENT", 4), ("LOCAL", 2), ("CELL", 8), ("SKETCH_BLOCK", 8), ("HOT", hot), ("SKETCH", sketch)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(spark, docs).collect()}
    assert got == near_plain(rows)


def test_leading_components():
    """What a tile's cells compare is every pair of members of different components, once."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(0, 60))
        tile = np.sort(rng.integers(0, 4, n).astype(np.uint64))
        root = rng.choice([1, 1, 1, 1, 2, 3], n) if rng.random() < 0.7 else rng.integers(0, 9, n)
        about = {k: v.tolist() for k, v in ngram_join.led(tile, root).items()}
        for t in set(tile.tolist()):
            at = [k for k in range(n) if tile[k] == t]
            lead, rest = [k for k in at if about["lead"][k]], [k for k in at if not about["lead"][k]]
            assert all(root[k] == root[lead[0]] for k in lead) and (not lead or 2 * len(lead) > len(at))
            assert bool(lead) == any(2 * sum(root[at] == x) > len(at) for x in root[at])
            assert all(about["several"][k] == (len(set(root[rest])) > 1) for k in at)
            for own, name in ((lead, "leads"), (rest, "rests")):
                assert all(about[name][k] == -(-len(own) // ngram_join.CELL) for k in at)


def links_plain(rows):
    """Of each document the other sets, and the other documents, that link with it."""
    sets = {i: shingles(t) for i, t in rows}
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    return {i: (sum(like(s, o) for o in set(sets.values()) - {s}), sum(like(s, o) for j, o in sets.items() if j != i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [512, 6])
def test_near_counts_every_link(spark, monkeypatch, block):
    """Families of distinct near copies, with copies of some, a chain, a pair and texts without links."""
    import random

    rng = random.Random(5)
    texts = []
    for f, size in ((0, 25), (1, 12), (2, 2)):
        for _ in range(size):
            w = [f"f{f}w{x}" for x in range(150)]
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += texts[:3] + [texts[30]] + [texts[0].upper(), None, " ", "alone with few words"]
    texts += [" ".join(f"c{x}" for x in range(9 * k, 9 * k + 100)) for k in range(12)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    got = {r.doc_id: (r.n_links, r.n_similar) for r in join(spark, docs).collect()}
    want = links_plain(rows)
    assert got == want and max(links for links, _ in want.values()) >= 20


def test_near_stage_and_empty(spark, edge, edge_rows):
    assert join(spark, edge.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in join(spark, blank).collect()) == [(1, 0, 1), (2, 0, 2)]
    some = (1, 2, 3, 4, 9, 10)
    left = ngram_join.one_of_each(spark, edge.where(f"doc_id in {some}"))
    roots = {root for _, root in near_plain([r for r in edge_rows if r[0] in some]).values()}
    assert sorted(r.doc_id for r in left.collect()) == sorted(roots) and len(roots) < 5 and left.columns == edge.columns


def test_near_rows_of_one_id(spark):
    """Rows under repeated and null ids are each compared, returned and dropped by themselves."""
    base, other, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, base), (2, other), (2, base + " more"), (3, third), (3, "short and alone it stays"), (None, third + " end"), (None, "of its own without an id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.text for r in ngram_join.one_of_each(spark, docs).collect() if r.text) == sorted([base, other, third, rows[4][1], rows[6][1]])
    assert sum(r.doc_id is None for r in join(spark, docs).collect()) == 3


def test_bounds_never_lose_a_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        sa, sb = (np.frombuffer(ngram_join.signature(x), np.uint8)[None, :] for x in (a, b))
        w = min(sa.shape[1], sb.shape[1])
        both = len(np.intersect1d(a, b))
        ok = ngram_join.may_reach(ngram_join.folded(sa, w), ngram_join.folded(sb, w), np.array([len(a)]), np.array([len(b)]), 75)[0]
        assert ok or 100 * both < 75 * (len(a) + len(b) - both)


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(70)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "c").collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in list(root)}


# ---- substrings


def spans_plain(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = Counter()
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "segments"), [(40, 20_000), (40, 6), (400, 20_000)])
def test_substrings(spark, edge, edge_rows, length, segments):
    got = repeated_spans(spark, edge, length=length, bucket_segments=segments).drop("spans").collect()
    assert Counter(map(tuple, got)) == spans_plain(edge_rows, length)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh "])
def test_substrings_of_few_letters(spark, alphabet):
    import random

    rng = random.Random(len(alphabet))
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(10)]
    rows = [(k, "".join(rng.choice(parts)[rng.randint(0, 9) :] for _ in range(3)) + "".join(rng.choice(alphabet + "é") for _ in range(15))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for segments in (20_000, 5):
        got = repeated_spans(spark, docs, length=24, bucket_segments=segments).drop("spans").collect()
        assert Counter(map(tuple, got)) == spans_plain(rows, 24)


@pytest.mark.parametrize("segments", [200, 20_000])
def test_substrings_of_one_passage_in_many_contexts(spark, segments):
    """A passage that most documents share makes a key with more segments than a bucket holds."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(150))[:800]
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 90))) + " " + (passage if k % 4 else "") + " " + " ".join(word() for _ in range(rng.randint(0, 90)))) for k in range(1200)]
    rows += [(5000 + k, rows[k][1]) for k in range(3)] + [(1, rows[1][1]), (None, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = repeated_spans(spark, docs, bucket_segments=segments).drop("spans").collect()
    assert Counter(map(tuple, got)) == spans_plain(rows, 400)


def test_substrings_empty(spark, edge):
    assert repeated_spans(spark, edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.Shape(2)


def test_multikey_sort():
    import random

    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\x01") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    order, common = multikey_sort(strings)
    padded = [strings[k].ljust(32, b"\0") for k in order]
    assert padded == sorted(padded)
    for k in range(1, len(padded)):
        same = next((j for j in range(32) if padded[k][j] != padded[k - 1][j]), 32)
        assert common[k] == same
