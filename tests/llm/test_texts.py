"""Decontamination, segmentation, token counts and chat repair against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelode.llm import bytetext as bt
from tidelode.llm import chat_repair as chat
from tidelode.llm import decontaminate as dc
from tidelode.llm import piece_lattice as pl
from tidelode.llm import token_tree as tt
from tidelode.llm.fm_index import FmIndex, suffix_array
from tidelode.llm.queries import tokenizer_file


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- index


def test_index():
    rng = np.random.default_rng(0)
    for n, symbols in ((0, 3), (1, 3), (50, 3), (400, 6), (300, 40)):
        seq = rng.integers(1, symbols, n)
        full = [*seq.tolist(), 0]
        assert suffix_array(np.array(full)).tolist() == sorted(range(n + 1), key=lambda k: full[k:])
        index = FmIndex(seq, symbols, sample=5)
        for long in (1, 2, 3):
            phrases = rng.integers(1, symbols, (20, long))
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases.tolist(), lo, hi, strict=True):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(n - long + 1) if seq[k : k + long].tolist() == p]


# ---- decontamination


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def leaks_plain(rows, items, size=10):
    windows = {}
    for name, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).update([] if name is None else [str(name)])
    out = Counter()
    for i, t in rows:
        w = tokens(t)
        hit, names = set(), set()
        for long in {len(k) for k in windows}:
            for k in range(len(w) - long + 1):
                if tuple(w[k : k + long]) in windows:
                    hit.update(range(k, k + long))
                    names |= windows[tuple(w[k : k + long])]
        out[i, len(w), len(hit), len(names), ",".join(sorted(names)), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 200])
@pytest.mark.parametrize("shard", [dc.SHARD_SYMBOLS, 40])
def test_contamination(spark, edge, edge_rows, monkeypatch, block, shard):
    monkeypatch.setattr(dc, "SHARD_SYMBOLS", shard)
    long = next(t for i, t in edge_rows if i == 1)
    w = long.split()
    items = [(1, " ".join(w[10:40])), (2, " ".join(w[35:60]).upper()), (3, "one two"), (3, "the same the same the same the same the same the same"), (4, None), (5, "!!"), (6, "not there at all but long enough to be a window"), (None, " ".join(w[80:95])), (10, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(spark, edge, benchmark, block_bytes=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == leaks_plain(edge_rows, items)
    by_id = {r.doc_id: r for r in got}
    body = long.encode()
    for s in by_id[1].spans:
        assert tokens(body[s.first : s["last"]].decode()) == tokens(long)[s.lo : s.hi]


def test_contamination_of_nothing(spark, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(spark, edge, none).where("contaminated").count() == 0
    assert dc.contamination(spark, edge.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    left = dc.clean_documents(spark, edge, some)
    assert left.columns == edge.columns and left.count() == edge.count() - 2


def test_contaminated_rows_of_one_id(spark):
    rows = [(1, "one two three"), (1, "clean words"), (None, "say one two three"), (None, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert sorted(r.text for r in dc.clean_documents(spark, docs, some).collect()) == ["clean words", "nothing here"]


# ---- segmentation


@pytest.fixture(scope="module")
def pieces():
    return pl.Pieces.load(tokenizer_file("piece_bpe_32k.model"))


def paths_plain(pieces, text, n):
    unit, found = (b" " + text.encode()) if text else b"", []

    def walk(j, steps, score, ids):
        if j == 0:
            found.append((-score, tuple(steps), ids))
            return
        for k in range(1, j + 1):
            part = unit[j - k : j]
            i = pieces.ids.get(part)
            if i is not None:
                walk(j - k, [*steps, -k], score + pieces.scores[i], [i, *ids])
            elif k == pl._LEAD[part[0]]:
                walk(j - k, [*steps, -k], score + pieces.unknown, [int(pieces.byte_id[b]) for b in part] + ids)

    walk(len(unit), [], 0.0, [])
    return sorted(found, key=lambda x: x[:2])[:n]


def test_paths(pieces):
    rng = random.Random(1)
    texts = ["", " ", "a", "the then", "a  b", "\n", "x\ny", "é漢", "▁", "🎉a", "ab\x00", " lead", "tail ", "don't."]
    texts += ["".join(rng.choice("thereion .,\n") for _ in range(rng.randint(1, 10))) for _ in range(40)]
    encoder = pl.Encoder(pieces, 4)
    for part in bt.slices(pa.array(texts, pa.large_string()), 40):
        for text, (ids, best) in zip(texts[part.lo : part.hi], encoder.encode(part), strict=True):
            want = paths_plain(pieces, text, 4)
            assert ids.tolist() == want[0][2]
            assert [p.score for p in best] == pytest.approx([-x[0] for x in want])
            own = [p.ids(ids).tolist() for p in best]
            assert all(pl.decode(pieces, np.array(x, np.int64)) == text.encode() and len(x) == p.n_tokens for x, p in zip(own, best, strict=True))
            assert len({tuple(x) for x in own}) == len(own)
            # of equal scores either path may be named; the scores of the ids named are those of the path
            scores = {tuple(x[2]): -x[0] for x in paths_plain(pieces, text, 10**6)}
            assert [scores[tuple(x)] for x in own] == pytest.approx([p.score for p in best])


def test_long_search(pieces):
    """Iterative deepening finds the paths of the search by an agenda, in its order."""
    rng = random.Random(6)
    units = [b" there", b" ", b"\n", b"ab" * 20, b"z" * 30, " été漢字🎉".encode(), b" aaaa\x01b"]
    units += ["".join(rng.choice("thereionaé漢🎉") for _ in range(rng.randint(1, 14))).encode() for _ in range(60)]
    for unit in units:
        for n in (1, 2, 7):
            want, got = pl.n_best(pieces, unit, n), pl.LongUnit(pieces, unit).n_best(n)
            assert [(pytest.approx(s), x.tolist()) for s, x in got] == want, unit


def test_a_very_long_unit_takes_little_memory():
    """A megabyte without spaces, in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource, sys
import pyarrow as pa
from tidelode.llm import bytetext as bt, piece_lattice as pl
from tidelode.llm.queries import tokenizer_file
pieces = pl.Pieces.load(tokenizer_file("piece_bpe_32k.model"))
rng = random.Random(3)
text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=500_000)) + "ab" * 250_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(part,) = bt.slices(pa.array([text], pa.large_string()))
((ids, best),) = pl.Encoder(pieces, 4).encode(part)
assert len(best) == 4 and all(pl.decode(pieces, p.ids(ids)) == text.encode() for p in best)
assert best[0].score >= best[1].score >= best[2].score >= best[3].score
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 500


def test_star_search(pieces):
    for unit in (b" there", b" a", b" xq", "é漢".encode()):
        want = sorted(paths_plain(pieces, unit.decode()[1:], 8), key=lambda x: x[:2]) if unit[0] == 32 else None
        got = pl.n_best(pieces, unit, 8)
        if want is not None:
            assert [(s, ids) for s, ids in got] == [(-c, ids) for c, _, ids in want]
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_segmented(spark, edge, edge_rows):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = pl.segmented(spark, edge, path)
    got = rows.collect()
    assert len(got) == len(edge_rows) and all(r.exact and r.n_tokens == len(r.ids) and r.score == r.best[0].score for r in got)
    assert all(p.exact and p.n_tokens == len(p.ids) and hashlib.sha256(np.array(p.ids, "<u4").tobytes()).hexdigest() == p.ids_sha256 for r in got for p in r.best)
    assert max(len(r.best) for r in got) == 4 and all(len({tuple(p.ids) for p in r.best}) == len(r.best) for r in got)
    back = Counter((r.doc_id, r.text) for r in pl.desegmented(spark, rows, path).collect())
    assert back == Counter((i, t or "") for i, t in edge_rows)
    assert pl.segmented(spark, edge.limit(0), path).count() == 0


def test_long_units(pieces):
    encoder = pl.Encoder(pieces, 2)
    text = "ab" * 400 + " " + "z" * 70
    (part,) = bt.slices(pa.array([text], pa.large_string()))
    ((ids, best),) = encoder.encode(part)
    assert pl.decode(pieces, ids).decode() == text and best[0].score >= best[1].score
    assert best[0].score == pytest.approx(sum(pl.n_best(pieces, u, 1)[0][0] for u in (b" " + b"ab" * 400, b" " + b"z" * 70)))


# ---- token counts


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edits(monkeypatch, leaf):
    monkeypatch.setattr(tt, "LEAF", leaf)
    counter, rng = tt.Counter(tt.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))), random.Random(leaf)
    letters = "ab é'slltdmrev   \n\t1 2.,!-🎉"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 200])))
        tree = tt.TokenTree(counter, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 20]))
            put = "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 2, 8, 40])))
            tree.edit(a, b, put)
            text = text[:a] + put + text[b:]
            assert tree.text == text and tree.total == len(counter.coding.encode_ordinary(text))


@pytest.mark.parametrize("leaf", [1, 8, 64])
def test_many_edits(monkeypatch, leaf):
    """Hundreds of edits of one text, at one spot, in order and all over, and cuts that empty it."""
    monkeypatch.setattr(tt, "LEAF", leaf)
    counter, rng = tt.Counter(tt.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))), random.Random(leaf)
    for where in (lambda n, k: min(n, 40), lambda n, k: min(n, 3 * k), lambda n, k: rng.randint(0, n)):
        text = "some words, 12 here  and there\n" * 60
        tree = tt.TokenTree(counter, text)
        for k in range(400):
            a = where(len(text), k)
            b = min(len(text), a + rng.choice([0, 0, 2, 9, 60 if k % 50 else 1500]))
            put = rng.choice(["x y ", " ", "don't", "", "12 \n\n ", "a b c d e f g h "])
            tree.edit(a, b, put)
            text = text[:a] + put + text[b:]
            if k % 20 == 0:
                assert tree.text == text and tree.total == len(counter.coding.encode_ordinary(text))
        assert tree.text == text and tree.total == len(counter.coding.encode_ordinary(text))
        assert sum(len(x.lengths) for x in tree.leaves) == len(counter.split.findall(text)) and sum(x.chars for x in tree.leaves) == len(text)


def test_edits_cost_what_they_touch():
    """Thousands of edits of a long text take about as long each as of a short one."""
    import time

    counter = tt.Counter(tt.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")))
    spent = []
    for repeat in (1_000, 100_000):
        tree = tt.TokenTree(counter, "some words here " * repeat)
        rng, began = random.Random(0), time.process_time()
        for _ in range(2000):
            a = rng.randint(0, tree.root.chars)
            tree.edit(a, a, "one more ")
        spent.append(time.process_time() - began)
    assert spent[1] < 5 * spent[0] + 0.5


def test_edits_touch_little():
    counter = tt.Counter(tt.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")))
    tree = tt.TokenTree(counter, "some words here " * 5000)
    tree.edit(40_000, 40_003, "X")
    assert tree.reread < 20
    with pytest.raises(ValueError):
        tree.edit(5, 10**9, "")


def test_edited_counts(spark, edge, edge_rows):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    counter = tt.Counter(tt.read_ranks(path))
    got = tt.edited_counts(spark, edge, path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(counter.coding.encode_ordinary(t or ""))) for i, t in edge_rows)
    docs = spark.createDataFrame([(1, "mail me@example.com or +1 (706) 555-3138 now", [(0, 4, "write")]), (2, None, None)], "doc_id long, text string, edits array<struct<start:int,end:int,put:string>>")
    rows = {r.doc_id: r for r in tt.edited_counts(spark, docs, path).collect()}
    assert rows[1].n_edits == 2 and rows[1].n_tokens_after == len(counter.coding.encode_ordinary("mail [EMAIL] or [PHONE] now")) and rows[2].n_tokens == 0
    rows = {r.doc_id: r for r in tt.edited_counts(spark, docs, path, edits_col="edits").collect()}
    assert rows[1].n_tokens_after == len(counter.coding.encode_ordinary("write me@example.com or +1 (706) 555-3138 now")) and rows[2].n_edits == 0
    assert tt.edited_counts(spark, edge.limit(0), path).count() == 0


# ---- chat


def least_cost(roles):
    best = float("inf")

    def walk(k, state, cost):
        nonlocal best
        if k == len(roles):
            best = min(best, cost + chat.EMPTY_COST * len(chat.ENDS[state]))
            return
        own = chat._role(roles[k])
        for b in (1, 2, 3):
            price = 0 if b == own else chat.UNKNOWN_COST if own == 0 else chat.RELABEL_COST
            if b == state:
                walk(k + 1, b, cost + price + chat.MERGE_COST)
            front = [(state, 0)]
            for _ in range(4):
                for s, e in front:
                    if b in chat._AFTER[s]:
                        walk(k + 1, b, cost + price + chat.EMPTY_COST * e)
                front = [(x, e + 1) for s, e in front for x in chat._AFTER[s]]

    walk(0, chat.START, 0.0)
    return best


def path_plain(roles):
    """The cheapest path of a conversation and, of equal ones, the first by its turns' choices from the last one
    on: (action, role, empty turns) of each turn."""
    states = {0: (0.0, ())}  # least cost, then the choices from this state back
    for name in roles:
        own, after = chat._role(name), {}
        for a, (cost, back) in states.items():
            ways = []
            for b in (1, 2, 3):
                price = 0 if b == own else chat.UNKNOWN_COST if own == 0 else chat.RELABEL_COST
                if (a, b) in chat.GAPS:
                    ways.append((0 if b == own else 2, len(chat.GAPS[a, b]), b, price + chat.EMPTY_COST * len(chat.GAPS[a, b])))
                if a == b:
                    ways.append((1, 0, b, price + chat.MERGE_COST))
            for kind, empty, b, price in ways:
                key = (cost + price, (((kind, empty, a), b), *back))
                if b not in after or key[0] < after[b][0] or (key[0] == after[b][0] and [x[0] for x in key[1]] < [x[0] for x in after[b][1]]):
                    after[b] = key
        states = after
    total = {b: cost + chat.EMPTY_COST * len(chat.ENDS[b]) for b, (cost, _) in states.items()}
    last = min(total, key=lambda b: (total[b], b))
    return [(("keep", "merge", "relabel")[kind], chat.ROLES[b - 1], empty) for (kind, empty, _), b in reversed(states[last][1])]


@pytest.mark.parametrize("block", [256, 1, 2, 3, 7])
def test_chat_paths(spark, block):
    """The path and its rendering are those of the plain version, however conversations are cut."""
    rng = random.Random(12)
    convs = {c: [rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant"]) for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))] for c in range(150)}
    turns = spark.createDataFrame([(c, k, r, f"t{k}") for c, roles in convs.items() for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string").repartition(3)
    got = {}
    for r in sorted(chat.repaired(spark, turns, block).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append(r)
    for c, roles in convs.items():
        want = path_plain(roles)
        assert [(r.action, r.out_role, r.n_empty) for r in got[c]] == want, roles
        said, at = [], 0
        for k, (action, role, empty) in enumerate(want):
            if action == "merge":
                said[-1][1] += f"\nt{k}"
            else:
                said += [[chat.ROLES[x - 1], ""] for x in chat.GAPS[at, chat.ROLES.index(role) + 1][:empty]] + [[role, f"t{k}"]]
            at = chat.ROLES.index(role) + 1
        said += [[chat.ROLES[x - 1], ""] for x in chat.ENDS[at]]
        want_text = "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in said)
        assert "".join(r.piece for r in got[c]) == want_text


@pytest.mark.parametrize("block", [256, 2])
def test_chat(spark, block):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(25):
        roles = [rng.choice(["user", "assistant", "system", "tool", None, "User ", "assistant"]) for _ in range(rng.randint(1, 5))]
        want[c] = least_cost(roles)
        rows += [(c, k, r, None if rng.random() < 0.1 else f"t{k}", 1) for k, r in enumerate(roles)]
    rows += [(None, 0, "user", "x", 1), (99, 0, "user", "same", 1), (99, 0, "user", "same", 1), (98, None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = chat.repaired(spark, turns, block).collect()
    assert len(got) == len(rows)
    byc = {}
    for r in sorted(got, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        byc.setdefault(r.conv_id, []).append(r)
    for c, own in byc.items():
        if c in want:
            assert own[0].cost == want[c]
        text = "".join(r.piece for r in own)
        seq = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert text.count(chat.END) == len(seq) and text.endswith(chat.END)
        seq = seq[1:] if seq[0] == "system" else seq
        assert seq == ["user", "assistant"] * (len(seq) // 2)
    assert chat.repaired(spark, turns.limit(0)).count() == 0


def test_chat_keeps_a_legal_conversation(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.repaired(spark, turns).collect(), key=lambda r: r.place)
    assert "".join(r.piece for r in rows) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n" and rows[0].cost == 0


def test_items_digest():
    assert dc.items_digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()


def test_chat_sorts_no_texts(spark, monkeypatch):
    """Very long texts are written once and take no part in sorts by range, which sample their columns on the driver."""
    seen, kept = {}, chat.Workspace.write

    def write(self, df, name):
        seen[name] = (df.columns, df._jdf.queryExecution().optimizedPlan().toString())
        return kept(self, df, name)

    monkeypatch.setattr(chat.Workspace, "write", write)
    rows = [(c, 0, "user" if c % 2 else "user" * 100, "x" * 300_000 + str(c)) for c in range(20)] + [(7, 0, "user", "tie"), (7, 0, "user", "tie")]
    got = chat.repaired(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert [n for n, (columns, _) in seen.items() if "text" in columns] == ["turns"]
    assert not {"text", "role"} & set(seen["sorted"][0]) and "RepartitionByExpression [conv" in seen["sorted"][1]
    assert sorted(r.conv_id for r in got) == sorted(r[0] for r in rows) and sum(r.conv_id == 7 for r in got) == 3
    # a role that is too long to be one is unknown, and returned as it is
    assert all(r.cost >= chat.UNKNOWN_COST and r.role == "user" * 100 for r in got if r.conv_id % 2 == 0)
    again = chat.repaired(spark, spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string"), 2).collect()
    key = lambda r: (r.conv_id, r.place, r.piece, r.cost)
    assert sorted(map(key, got)) == sorted(map(key, again))
