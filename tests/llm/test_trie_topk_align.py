"""The trie of conversations, exact top-k and the alignment of two tokenizers, each against a plain version."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING
from tidelode.llm import prefix_trie as trie
from tidelode.llm import threshold_search as search

BPE, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


# --- trie


def plain_trie(rows):
    """rows: (conv_id, turn, role, text); turns of a conversation must differ."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def found_trie(spark, rows, clashing=True):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    df = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], f"conv_id long, turn long, role string, text string, {CLASHING}").repartition(3)
    got = trie.prefix_trie(spark, df)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in order) for r in got.collect())


def test_trie_of_many(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), 103, 104, 250, 300, 301, 399, 1000, 1001]:
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long " * 50])) for k in range(rng.randint(1, 7))]
    rows += [(7000 + k, 0, "user", "the same") for k in range(60)]  # copies, and prefixes of one another
    rows += [(9000 + c, k, "user", f"{k}") for c in range(9) for k in range(6 + c)]
    rows += [(5, None, "user", "null turn"), (None, 0, "user", "no id"), (-7, 0, "user", "negative"), (-7, 1, "user", "x" * 100_000)]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_long_conversations_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, k, "user", str(k if k != 17 + c % 3 else -c)) for c in (1, 2, 3, 204, 305) for k in range(33)]
    rows += [(600 + c, k, "user", f"t{k}") for c in range(20) for k in range(9)]  # equal ones, by pieces
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_defined_cases(spark):
    assert found_trie(spark, []) == []
    assert found_trie(spark, [(None, 0, "user", "x")]) == []
    # one turn twice, in either order, and a repeated row
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b")]
    assert found_trie(spark, rows) == found_trie(spark, rows[::-1])
    assert len(found_trie(spark, rows)) >= 1


def test_peel_waits_for_all_children(spark):
    from tidelode.llm.workspace import Workspace

    # 1 -> 2 -> 3 and 1 -> 4: the root may not finish with its first child
    rows = [(1, 0, None, None, 2, 0, 10), (2, 0, 1, 0, 1, 0, 20), (3, 0, 2, 0, 0, 1, 30), (4, 0, 1, 0, 0, 1, 40)]
    df = spark.createDataFrame(rows, "a long, b long, up_a long, up_b long, waits long, leaves long, saved long")
    got = {r["a"]: (r["leaves"], r["saved"]) for r in trie.peeled(df, Workspace(spark, "peel-test")).collect()}
    assert got == {1: (2, 100), 2: (1, 50), 3: (1, 30), 4: (1, 40)}


# --- top-k


def plain_top(rows, k=10, each=100):
    out = []
    alive = [(n, i, [int(np.floor(1024 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for n, i, v in alive:
        if i % each == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, j, w in alive if m != n and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found_top(spark, rows, **how):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    df = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], f"vec_id long, embedding array<float>, {CLASHING}").repartition(3)
    return sorted(tuple(r) for r in search.top_k(spark, df, F.col("vec_id") % 100 == 0, **how).select("query_id", "rank", "vec_id", "score").collect())


def floats(v):
    return [float(np.float32(x)) for x in v]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_CELLS", 8 * 64)  # several blocks
    monkeypatch.setattr(search, "QUERY_CELLS", 8 * 2)
    rng = np.random.default_rng(5)
    rows = [(k, floats(rng.normal(size=8) * 0.1)) for k in range(700)]
    same = floats(rng.normal(size=8))
    rows += [(1000 + k, same) for k in range(300)]  # ties by the hundred
    rows += [(3000, floats(np.zeros(8))), (3001, None), (3100, [1.0, None, *[0.0] * 6]), (3200, [float("nan")] * 8), (3300, [float("inf")] * 8), (None, same)]
    rows += [(4000, [1.0, 2.0]), (4001, [0.5, -1.0]), (4100, []), (4101, []), (4200, [1.0])]
    assert found_top(spark, rows) == plain_top(rows)


def test_top_k_repeated_ids_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (100, [0.0, 1.0])]
    assert found_top(spark, rows) == plain_top(rows)
    assert found_top(spark, []) == []


def test_scores_beyond_doubles(spark):
    big = float(np.float32(3e30))
    got = found_top(spark, [(0, [big, 1.0]), (1, [0.001, 1.0]), (2, [0.0, 1.0]), (3, [-1e-5, 0.0])])
    assert [r[2] for r in got] == [1, 2, 3]
    assert got[0][3] == (1 << 63) - 1 and got[1][3] == 1 << 20 and got[2][3] == -(1 << 63)  # held to a long


def test_threshold_stops_early():
    """With lists that fall steeply most of a block is left unread."""
    rng = np.random.default_rng(1)
    n = 4096
    values = np.floor(rng.exponential(50, size=(n, 3)) ** 2)
    block = search.Block(np.arange(n), np.arange(n), values)
    query = np.array([3.0, 2.0, 1.0])
    found, read = block.top(query, -1, 10)
    scores = values @ query
    want = sorted(zip(-scores, range(n), strict=True))[:10]
    assert [(-s, i) for s, i, _ in found] == [(int(s), i) for s, i in want]
    assert read < n // 4
    # a floor from another block ends it sooner, and reports what reaches it only
    found, less = block.top(query, -1, 10, int(-want[2][0]))
    assert [(-s, i) for s, i, _ in found] == [(int(s), i) for s, i in want[:3]] and less <= read


# --- alignment


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    docs = []
    for d, x in rows:
        groups = []
        if x:
            a, b = t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)
            pa_ = [bytes(chars[c] for c in t.id_to_token(i)) for i in a]
            pb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(pa_) == (" " + x).encode() == b"".join(pb):
                ends_a, ends_b = (np.cumsum([len(p) for p in q]).tolist() for q in (pa_, pb))
                p = q = 0
                for e in sorted({*ends_a} & {*ends_b}):
                    p2, q2 = ends_a.index(e, p) + 1, ends_b.index(e, q) + 1
                    groups.append((a[p:p2], b[q:q2]))
                    p, q = p2, q2
        docs.append((d, groups))
    count = Counter(pair for _, groups in docs for pair in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


HARD = [
    "a", " ", "  ", "\n", " \n ", "\t\t x", "don't 's 'll 've''s I'M", "x  y   z\n\n\nw \n v", "naïve café ﬁ ½ ①", "日本語のテキスト 中文 字", "😀👍🏽 é ​ x　y  z", "<|endoftext|> <s> </s> <unk> [INST]",
    "▁ already", "nul\0 byte", "\r\n\r\nint main() {\r\n\treturn 0;\r\n}", "12345678901234567890", "=" * 300, "ab" * 3000, " lead", "trail ", "word\u0085next", "a b c", " x y", "Ωmega ß ſ ŉ", "a\x7f b\x1f c",
]


@pytest.mark.skipif(not os.path.isfile(BPE), reason="no tokenizers here")
def test_alignment(spark, edge, edge_rows, monkeypatch):
    from tidelode.llm import token_align as align

    monkeypatch.setattr(align, "UNITS", 50)  # the driver's value does not reach workers; segments are tested below
    rows = [*edge_rows, *((500 + k, x) for k, x in enumerate(HARD))]
    extra = spark.createDataFrame([(i, x) for i, x in rows[len(edge_rows) :]], "doc_id long, text string")
    docs = edge.unionByName(extra, allowMissingColumns=True)
    got = sorted((tuple(r) for r in align.aligned(spark, docs, BPE, MODEL).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    assert got == plain_alignment(rows)


@pytest.mark.skipif(not os.path.isfile(BPE), reason="no tokenizers here")
def test_alignment_segments(edge_rows, monkeypatch):
    """Small segments give the same numbers of documents for pairs, and groups of the same keys."""
    import pyarrow as pa

    from tidelode.llm import bytetext as bt
    from tidelode.llm import token_align as align

    with open(BPE, "rb") as f, open(MODEL, "rb") as g:
        coding = align.Coding(f.read(), g.read())
    texts = [x or "" for _, x in edge_rows] + HARD

    def read(units):
        monkeypatch.setattr(align, "UNITS", units)
        held, keys, n = Counter(), set(), 1
        s = align.Segment(coding, 0)
        for part in bt.slices(pa.array(texts), 2000):
            s.documents(part)
            if s.full():
                held.update(dict(zip(s.pairs, s.held.tolist(), strict=True)))
                keys |= {*s.groups}
                s, n = align.Segment(coding, s.number + 1), n + 1
        held.update(dict(zip(s.pairs, s.held.tolist(), strict=True)))
        return {k: v for k, v in held.items() if v}, keys | {*s.groups}, n

    (one, keys, n), (many, more, m) = read(1 << 30), read(20)
    assert n == 1 and m > 5 and one == many and keys == more


@pytest.mark.skipif(not os.path.isfile(BPE), reason="no tokenizers here")
def test_alignment_of_nothing(spark):
    from tidelode.llm import token_align as align

    assert align.aligned(spark, spark.createDataFrame([], "doc_id long, text string"), BPE, MODEL).collect() == []
    bad = spark.range(1).selectExpr("id as doc_id", "cast(x'61ff62' as string) as text")
    assert tuple(align.aligned(spark, bad, BPE, MODEL).first()) == (0, 0, 0, 0, 0, 0, 0, "")
