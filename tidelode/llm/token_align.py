"""Links between the tokens of two tokenizers, by a dictionary of groups.

A text with a space in front is encoded by a byte-level BPE (A) and by a sentence piece model (B). Where tokens of
both end at the same byte, a group ends; every A token of a group is linked with every B token of it.

A unit is a word with the white space in front of it: it begins at a space or newline that follows another character.
Neither tokenizer has a token across such a place, nor looks behind it, so a unit is encoded, cut into groups and
written down once and stands for all its occurrences. Tasks intern units and groups; a segment is what one task reads
until its dictionary is full. Each document is kept as numbers of its segment's groups with their frequencies; a
segment adds its groups (one row each), and for each id pair how many of its documents hold it linked, which is
exact, as a document lies in one segment. Counts of pairs are summed over segments; each distinct group of the corpus
is expanded into its id pairs once, which gives the sum of their counts and the links that are their A id's best;
these values go back to the segments by the group's key, and to documents by their segment. A frequent group is one
row of each segment, so no key is hot.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no
tokens: zeros and an empty string. Invalid UTF-8 is such a text. Rows with a repeated or null doc_id are each
returned. An empty table gives no rows. A very long text is held by one task; so are the distinct id pairs of
one group. Other columns are not read. Groups are known by 128-bit hashes of their ids, units by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.token_tree import PATTERN
from tidelode.llm.workspace import Workspace, row_keyed, sized

#: Distinct units, and entries of documents' lists, after which a segment ends.
UNITS, ENTRIES = 600_000, 8_000_000
#: Bytes of text handled at once.
SLICE = 2 << 20

_U = np.uint64


class Coding:
    """Both tokenizers, by the content of their files."""

    def __init__(self, bpe_json: bytes, model: bytes):
        import sentencepiece
        import tiktoken

        chars = _byte_chars()
        read = json.loads(bpe_json)["model"]
        self.a_bytes = _listed({k: bytes(chars[c] for c in t) for t, k in read["vocab"].items() if all(c in chars for c in t)})
        merges = [m if isinstance(m, list) else m.split(" ") for m in read["merges"]]
        made = [read["vocab"][x + y] for x, y in merges]
        if any(p >= q for p, q in zip(made, made[1:], strict=False)):
            raise ValueError("ids of merged tokens must rise with their merges")
        # single bytes and merged tokens: the rest (special tokens) never comes from text
        usable = {*made, *(read["vocab"][c] for c in chars)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.a_bytes[k]: k for k in usable}, special_tokens={})._core_bpe
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = {k: self.b.id_to_piece(k) for k in range(self.b.get_piece_size())}
        self.b_bytes = _listed({k: bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in pieces.items()})
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        inner = [p for k, p in pieces.items() if "▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1)]
        if inner:
            raise ValueError(f"pieces go on behind white space: {inner[:3]}")

    def encode(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each unit by A and by B, empty where the unit is no UTF-8."""
        texts = [x.decode("utf-8", "ignore") for x in units]
        # behind a newline, whose piece stands alone, no space is added in front of the unit
        return [self.a.encode_ordinary(x) for x in texts], [x[2:] for x in self.b.encode(["\n" + x for x in texts], num_threads=1)]


def _byte_chars() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, others for 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}


def _listed(by_id: dict[int, bytes]) -> list[bytes]:
    return [by_id.get(k, b"") for k in range(max(by_id) + 1)]


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of units: those of rows, and spaces and newlines behind a byte that ends no white space."""
    gap = (data == 0x20) | (data == 0x0A)
    solid = (data > 0x20) & (data != 0x7F)
    if (data >= 0x80).any():
        solid &= ~_ends_wide_space(data)
    first = gap.copy()
    first[1:] &= solid[:-1]
    first[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(first)


def _ends_wide_space(data: np.ndarray) -> np.ndarray:
    """Last bytes of characters that may be white space: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000."""
    one = np.concatenate(([0], data[:-1]))
    two = np.concatenate(([0, 0], data[:-2]))[: len(data)]
    return ((one == 0xC2) & ((data == 0x85) | (data == 0xA0))) | ((two == 0xE1) & (one == 0x9A)) | ((two == 0xE2) & ((one == 0x80) | (one == 0x81))) | ((two == 0xE3) & (one == 0x80))


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places begin[k] to begin[k] + count[k] - 1 for all k, one after the other."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Rows:
    """Lists of numbers, one after the other, to which lists are added."""

    def __init__(self):
        self.flat, self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def of(self, which: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.begin[which], self.count[which])]


class Segment:
    """The dictionary of a segment: units, groups, and id pairs with the number of documents that hold them."""

    def __init__(self, coding: Coding, number: int):
        self.coding, self.number = coding, number
        self.units: dict[int, int] = {}
        self.said: list[bytes] = []  # of a unit
        self.sums = np.zeros((5, 0), np.int64)  # of a unit: A tokens, B tokens, groups, links, 1 if it does not come back
        self.unit_groups = Rows()
        self.groups: dict[tuple[int, int], int] = {}
        self.group_said: list[bytes] = []
        self.group_a, self.group_b, self.times_a, self.times_b = Rows(), Rows(), Rows(), Rows()  # distinct ids of a group, and how often it has them
        self.group_pairs = Rows()
        self.pairs: dict[int, int] = {}
        self.held = np.zeros(0, np.int64)  # of a pair: documents
        self.entries = 0

    def full(self) -> bool:
        return len(self.said) >= UNITS or self.entries >= ENTRIES

    def look(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number of each unit of the data; new ones are encoded."""
        long = np.diff(np.append(begin, len(data)))
        off = np.arange(len(data)) - np.repeat(begin, long)
        h = bt.splitmix(np.add.reduceat(bt.BYTE_KEY[data] * bt.place_keys(int(long.max()))[off], begin) + long.astype(_U))
        each, first, which = np.unique(h, return_index=True, return_inverse=True)
        keys = each.tolist()
        numbers = [self.units.get(x, -1) for x in keys]
        new = [k for k, x in enumerate(numbers) if x < 0]
        if new:
            for k in new:
                numbers[k] = self.units[keys[k]] = len(self.units)
            at = first[new]
            self._learn([data[x : x + n].tobytes() for x, n in zip(begin[at].tolist(), long[at].tolist(), strict=True)])
        return np.array(numbers, np.int64)[which]

    def _learn(self, units: list[bytes]) -> None:
        c = self.coding
        a, b = c.encode(units)
        good = [b"".join([c.a_bytes[x] for x in p]) == u == b"".join([c.b_bytes[x] for x in q]) for u, p, q in zip(units, a, b, strict=True)]
        a, b = ([x if g else [] for x, g in zip(y, good, strict=True)] for y in (a, b))
        n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        a, b = (np.array([i for x in y for i in x], np.int64) for y in (a, b))
        end_a, end_b = np.cumsum(c.a_size[a]), np.cumsum(c.b_size[b])
        last_a = end_b[np.searchsorted(end_b, end_a)] == end_a if len(a) else np.zeros(0, bool)
        last_b = end_a[np.searchsorted(end_a, end_b)] == end_b if len(b) else np.zeros(0, bool)
        in_a, in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # the group of each token
        total = int(last_a.sum())
        g_a, g_b = np.bincount(in_a, minlength=total), np.bincount(in_b, minlength=total)
        n_groups = _per_unit(last_a, n_a)
        links = g_a * g_b
        numbers = self._groups(a, b, in_a, in_b, g_a, g_b)
        n_links = _per_unit(links, n_groups)
        self.sums = np.concatenate([self.sums, np.stack([n_a, n_b, n_groups, n_links, 1 - np.array(good, np.int64)])], axis=1)
        self.unit_groups.add(numbers, n_groups)
        said, at = [self.group_said[g] for g in numbers.tolist()], 0
        for n in n_groups.tolist():
            self.said.append(b";".join(said[at : at + n]))
            at += n

    def _groups(self, a, b, in_a, in_b, g_a, g_b) -> np.ndarray:
        """The number of each group; new ones get their text, distinct ids and id pairs."""
        begin_a, begin_b = np.cumsum(g_a) - g_a, np.cumsum(g_b) - g_b
        h = []
        for seed in (0, 1 << 62):
            parts = []
            for side, ids, of, begin in ((0, a, in_a, begin_a), (1, b, in_b, begin_b)):
                place = np.arange(len(ids)) - begin[of]
                mixed = bt.splitmix(bt.splitmix(_U(seed + side) + ids.astype(_U) * _U(2)) + place.astype(_U))
                sums = np.concatenate((np.zeros(1, _U), np.cumsum(mixed, dtype=_U)))
                ends = np.append(begin[1:], len(ids)) if len(begin) else begin
                parts.append(sums[ends] - sums[begin])
            h.append(bt.splitmix(parts[0] + bt.splitmix(parts[1])))
        order = np.lexsort((h[1], h[0]))
        x, y = h[0][order], h[1][order]
        lead = np.ones(len(x), bool)
        lead[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.minimum.reduceat(order, np.flatnonzero(lead)) if len(x) else order
        keys = list(zip(x[lead].tolist(), y[lead].tolist(), strict=True))
        numbers = [self.groups.get(k, -1) for k in keys]
        new = [k for k, n in enumerate(numbers) if n < 0]
        for k in new:
            numbers[k] = self.groups[keys[k]] = len(self.groups)
        out = np.empty(len(x), np.int64)
        out[order] = np.array(numbers, np.int64)[np.cumsum(lead) - 1]
        if new:
            g = first[new]
            own_a, own_b = a[_spread(begin_a[g], g_a[g])], b[_spread(begin_b[g], g_b[g])]
            text_a, text_b = own_a.tolist(), own_b.tolist()
            p = q = 0
            for m, n in zip(g_a[g].tolist(), g_b[g].tolist(), strict=True):
                self.group_said.append(b"%d|%d" % (text_a[p], text_b[q]) if m == n == 1 else (",".join(map(str, text_a[p : p + m])) + "|" + ",".join(map(str, text_b[q : q + n]))).encode())
                p, q = p + m, q + n
            ids = []
            for own, count, rows, times in ((own_a, g_a[g], self.group_a, self.times_a), (own_b, g_b[g], self.group_b, self.times_b)):
                each, n = np.unique((np.repeat(np.arange(len(g)), count) << 32) | own, return_counts=True)
                per = np.bincount(each >> 32, minlength=len(g))
                rows.add(each & 0xFFFFFFFF, per)
                times.add(n, per)
                ids.append((each & 0xFFFFFFFF, per))
            (d_a, p_a), (d_b, p_b) = ids
            wide = np.repeat(p_b, p_a)  # each distinct A id meets the group's distinct B ids
            codes = (np.repeat(d_a, wide) << 32) | d_b[_spread(np.repeat(np.cumsum(p_b) - p_b, p_a), wide)]
            self.group_pairs.add(self._pairs(codes), p_a * p_b)
        return out

    def _pairs(self, codes: np.ndarray) -> np.ndarray:
        each, which = np.unique(codes, return_inverse=True)
        numbers = [self.pairs.setdefault(x, len(self.pairs)) for x in each.tolist()]
        self.held = np.concatenate([self.held, np.zeros(len(self.pairs) - len(self.held), np.int64)])
        return np.array(numbers, np.int64)[which]

    def documents(self, part: bt.Slice) -> dict[str, list | np.ndarray]:
        """Columns of a slice's documents: sums, digests, and the numbers and frequencies of their groups."""
        size = np.diff(part.starts)
        n, some = len(size), size > 0
        data = np.insert(part.data, part.starts[:-1][some], 0x20)
        starts = part.starts + np.concatenate(([0], np.cumsum(some)))
        sums, shas = np.zeros((4, n), np.int64), [""] * n
        none = np.zeros(0, np.int64)
        if not len(data):
            return {"sums": sums, "sha": shas, "groups": none, "times": none, "count": np.zeros(n, np.int64)}
        begin = unit_starts(data, starts)
        units = self.look(data, begin)
        bound = np.searchsorted(begin, starts)
        totals = np.concatenate((np.zeros((5, 1), np.int64), np.cumsum(self.sums[:, units], axis=1)), axis=1)
        own = totals[:, bound[1:]] - totals[:, bound[:-1]]
        whole = some & (own[4] == 0)
        sums[:, whole] = own[:4, whole]
        listed, said = units.tolist(), self.said
        for k in np.flatnonzero(whole).tolist():
            shas[k] = hashlib.sha256(b";".join([said[x] for x in listed[bound[k] : bound[k + 1]]])).hexdigest()
        # distinct units, groups and pairs of each document
        doc = np.repeat(np.arange(n), np.diff(bound))
        keep = whole[doc]
        key, often = np.unique(doc[keep] * len(said) + units[keep], return_counts=True)
        doc, unit = np.divmod(key, len(said))
        count = self.unit_groups.count[unit]
        code = np.repeat(doc, count) * max(1, len(self.group_said)) + self.unit_groups.of(unit)
        key, at = np.unique(code, return_inverse=True)
        times = np.bincount(at, weights=np.repeat(often, count), minlength=len(key)).astype(np.int64)
        doc, group = np.divmod(key, max(1, len(self.group_said)))
        count = self.group_pairs.count[group]
        code = np.unique(np.repeat(doc, count) * max(1, len(self.pairs)) + self.group_pairs.of(group))
        self.held += np.bincount(code % max(1, len(self.pairs)), minlength=len(self.held))
        self.entries += len(group)
        return {"sums": sums, "sha": shas, "groups": group, "times": times, "count": np.bincount(doc, minlength=n)}


def _per_unit(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of values over runs of the given lengths, some of them empty."""
    sums = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(count)
    return sums[ends] - sums[ends - count]


def _lists(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(flat, pa.int32()))


_INTS = pa.list_(pa.int32())
#: Documents (kind 0), groups (1) and pairs (2) of segments in one table, each with its own columns.
_KINDS = {"kind": pa.int32(), "segment": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "groups": _INTS, "times": _INTS,
          "number": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "a": _INTS, "a_times": _INTS, "b": _INTS, "b_times": _INTS, "a_id": pa.int32(), "b_id": pa.int32(), "held": pa.int64()}
_SCHEMA = "kind int, segment bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups array<int>, times array<int>, number int, h1 bigint, h2 bigint, a array<int>, a_times array<int>, b array<int>, b_times array<int>, a_id int, b_id int, held bigint"
#: Rows of a dictionary in one batch.
_BATCH = 20_000


def _batch(rows: int, row_ids: pa.Array, **columns) -> pa.RecordBatch:
    full = {k: columns[k] if k in columns else pa.nulls(rows, t) for k, t in _KINDS.items()}
    full = {k: v if isinstance(v, pa.Array) else pa.array(v, _KINDS[k]) for k, v in full.items()}
    return pa.RecordBatch.from_arrays([row_ids, *full.values()], names=["row_id", *full])


def _closing(s: Segment, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The dictionary of a segment that ends."""
    keys = np.array(list(s.groups), _U).reshape(-1, 2).view(np.int64)
    for lo in range(0, len(keys), _BATCH):
        at = np.arange(lo, min(lo + _BATCH, len(keys)))
        lists = {name: _lists(rows.of(at), rows.count[at]) for name, rows in (("a", s.group_a), ("a_times", s.times_a), ("b", s.group_b), ("b_times", s.times_b))}
        yield _batch(len(at), pa.nulls(len(at), kind), kind=np.full(len(at), 1), segment=np.full(len(at), s.number), number=at, h1=keys[at, 0], h2=keys[at, 1], **lists)
    codes = np.array(list(s.pairs), np.int64)
    some = np.flatnonzero(s.held)
    for lo in range(0, len(some), 4 * _BATCH):
        at = some[lo : lo + 4 * _BATCH]
        yield _batch(len(at), pa.nulls(len(at), kind), kind=np.full(len(at), 2), segment=np.full(len(at), s.number), a_id=codes[at] >> 32, b_id=codes[at] & 0xFFFFFFFF, held=s.held[at])


_coding: dict[bytes, Coding] = {}


def _encoded(files, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, model = files.value
        mark = hashlib.sha256(bpe + model).digest()
        if mark not in _coding:  # read once a worker
            _coding.clear()
            _coding[mark] = Coding(bpe, model)
        base = TaskContext.get().partitionId() << 24
        segment = Segment(_coding[mark], base)
        for batch in batches:
            ids = batch.column("row_id")
            for part in bt.slices(bt.column(batch, "body"), SLICE):
                x = segment.documents(part)
                n = part.hi - part.lo
                yield _batch(n, ids.slice(part.lo, n), kind=np.zeros(n), segment=np.full(n, segment.number), n_a=x["sums"][0], n_b=x["sums"][1], n_groups=x["sums"][2], n_links=x["sums"][3], groups_sha256=x["sha"], groups=_lists(x["groups"], x["count"]), times=_lists(x["times"], x["count"]))
                if segment.full():
                    yield from _closing(segment, kind)
                    segment = Segment(segment.coding, segment.number + 1)
        yield from _closing(segment, kind)

    return run


def _summed(kind: pa.DataType):
    names = ["row_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(key, docs: pa.Table, values: pa.Table) -> pa.Table:
        """Sums over the groups of a segment's documents."""
        number = np.asarray(values.column("number"), np.int64)
        worth = np.zeros((2, int(number.max(initial=-1)) + 1), np.int64)
        worth[0, number], worth[1, number] = np.asarray(values.column("n_best"), np.int64), np.asarray(values.column("count_sum"), np.int64)
        docs = docs.combine_chunks()
        groups, times = (np.asarray(pa.concat_arrays([c.flatten() for c in docs.column(n).chunks]) if len(docs) else pa.array([], pa.int32()), np.int64) for n in ("groups", "times"))
        count = np.asarray(pa.concat_arrays([c.value_lengths() for c in docs.column("groups").chunks]) if len(docs) else pa.array([], pa.int32()), np.int64)
        best, total = (_per_unit(w[groups] * times, count) for w in worth)
        return pa.table([*[docs.column(n) for n in names], pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*names, "n_best", "count_sum"])

    return run


def aligned(spark: SparkSession, docs: DataFrame, bpe_path: str, model_path: str) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    work = Workspace(spark, "aligned")
    rows, row = row_keyed(docs.select("doc_id", "text"), work)
    files = []
    for path in (bpe_path, model_path):
        with open(path, "rb") as f:
            files.append(f.read())
    shipped = spark.sparkContext.broadcast(tuple(files))  # the size of two vocabularies
    ids = rows.select(F.col(row).alias("row_id"), "doc_id") if row != "doc_id" else None
    texts = rows.select(F.col(row).alias("row_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    kind = dict(texts.dtypes)["row_id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    table = work.write(texts.mapInArrow(bt.lean(_encoded(shipped, arrow)), f"row_id {kind}, {_SCHEMA}"), "encoded")

    counts = work.write(table.where("kind = 2").groupBy("a_id", "b_id").agg(F.sum("held").alias("held")), "counts")
    best = work.write(counts.groupBy("a_id").agg(F.max("held").alias("most")), "best")  # as many rows as A has ids
    marked = counts.join(sized(best, 24), "a_id").select("a_id", "b_id", "held", (F.col("held") == F.col("most")).cast("bigint").alias("best"))

    groups = table.where("kind = 1")
    distinct = groups.groupBy("h1", "h2").agg(F.first(F.struct("a", "a_times", "b", "b_times")).alias("g"))
    left = distinct.select("h1", "h2", F.explode(F.arrays_zip("g.a", "g.a_times")).alias("x"), "g")
    links = left.select("h1", "h2", F.col("x.a").alias("a_id"), F.col("x.a_times").alias("m"), F.explode(F.arrays_zip("g.b", "g.b_times")).alias("y")).select("h1", "h2", "a_id", F.col("y.b").alias("b_id"), (F.col("m").cast("bigint") * F.col("y.b_times")).alias("times"))
    values = links.join(marked, ["a_id", "b_id"]).groupBy("h1", "h2").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    local = groups.select("segment", "number", "h1", "h2").join(values, ["h1", "h2"]).select("segment", "number", "n_best", "count_sum")

    again = spark.read.schema(table.schema).parquet(work.at("encoded"))  # a cogroup's sides need columns of their own
    found = again.where("kind = 0").select("segment", "row_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "times").groupBy("segment")
    schema = f"row_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    out = found.cogroup(local.groupBy("segment")).applyInArrow(bt.lean_cogroup(_summed(arrow)), schema)
    out = out.withColumnRenamed("row_id", "doc_id") if ids is None else out.join(ids, "row_id")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
