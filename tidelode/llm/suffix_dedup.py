"""Removal of long repeated byte strings by a sparse suffix array, sorted in range-partitioned buckets.

A byte goes if a string of `length` bytes covers it that also starts anywhere else in the corpus. Sorting
the suffix of every byte would move the corpus several hundred times over, so suffixes start at anchors
only. The anchor of a window of `length` bytes is the place of the smallest hash among its first `reach`
k-grams: it depends on the window's bytes alone, so equal windows have anchors at equal places in them.
All windows with one anchor make a segment: the bytes from its first window's start to its last one's end.

1. Anchors are found in one pass, each with a hash of the bytes that all its windows hold (the key) and a
   128-bit digest of its segment. A window can only repeat if its key does; other anchors end here.
2. Segments with one digest are equal: all their windows repeat. One of each digest goes on.
3. Segments that share a key with another are fetched. Sampled splitters part their suffixes (the text
   from the anchor on) by range of their leading bytes, as many as the key covers; each bucket is sorted by
   multikey quicksort, as are the reversed texts in front of the anchors. Two windows at the same offset are
   equal if the suffixes share enough bytes to the right and the reversed texts enough to the left, which the
   common prefixes of sorted neighbours tell for all segments of a bucket at once. Suffixes on two sides of a
   splitter differ in these leading bytes, which all windows hold, so no window is equal to one beyond it.
4. A passage in very many contexts makes a key with more segments than a bucket should hold, and no splitter
   parts them. Their windows are compared across tasks by 128-bit digests instead.

The splitters are those of Spark's range exchange: it samples a bounded number of leading bytes, whatever the
input, and the driver holds nothing else.

Repeated windows become spans of bytes, merged for each document.

Defined cases: null texts are empty; a document shorter than `length` loses nothing, but rows that repeat
are occurrences like any others; identifiers may repeat or be null; an empty table gives no rows. A very long text is
cut into segments by the task that reads it. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.workspace import Workspace, sized

LENGTH = 400
#: Segments that a bucket is meant for, which are also the most that one key may bring.
BUCKET_SEGMENTS = 10_000
#: Broadcast limits in bytes: keys and digests, which are many, and identifiers of documents concerned.
FEW_BYTES, DOCUMENT_BYTES = 1 << 20, 8 << 20
#: Bytes of text that are searched for anchors at once.
STEP_BYTES = 1 << 18

_KEY = ["id", "mark"]


class Shape:
    """The k-grams, the reach and the key that go with a length."""

    def __init__(self, length: int):
        if not 4 <= length < 1 << 15:
            raise ValueError("length must be from 4 to 32767 bytes")
        self.length = length
        self.gram = 8 if length >= 32 else 2
        self.reach = max(1, length * 3 // 4 - self.gram + 1)
        self.key = length - self.reach + 1


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bytes, laid end to end: row, anchor, first and last window start of each segment."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < shape.length:
        return none, none, none, none
    x, have = data.astype(np.uint64), 1
    while have < shape.gram:
        x = x[: len(x) - have] | x[have:] << np.uint64(8 * have)
        have *= 2
    x = bt.splitmix(x) & np.uint64(0xFFFFFFFF00000000)
    # of equal hashes the last one is smallest
    x |= np.uint64(0xFFFFFFFF) - np.arange(len(x), dtype=np.uint64)
    at = (np.uint64(0xFFFFFFFF) - (_least(x, shape.reach)[: n - shape.length + 1] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    # windows inside one row: those that end by its end
    inside = np.zeros(n + 1, np.int64)
    long = np.diff(starts)
    rows = np.flatnonzero(long >= shape.length)
    if not len(rows):
        return none, none, none, none
    np.add.at(inside, starts[rows], 1)
    np.add.at(inside, starts[rows + 1] - shape.length + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[: n - shape.length + 1])
    at = at[p]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return np.searchsorted(starts, p[first], side="right") - 1, at[first], p[first], p[last]


def _anchored(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id"), batch.column("mark")
            for part in bt.slices(bt.column(batch, "body"), STEP_BYTES):
                row, at, first, last = anchors(part.data, part.starts, shape)
                if not len(row):
                    continue
                body, key, end = memoryview(part.data), shape.key, (last + shape.length).tolist()
                keys = np.array([xxhash.xxh3_64_intdigest(body[a : a + key]) for a in at.tolist()], np.uint64)
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[a:b]) for a, b in zip(first.tolist(), end, strict=True)]), np.int64).reshape(-1, 2)
                place = (at - part.starts[row]) << 32 | (at - last) << 16 | (at - first)
                take = pa.array(row + part.lo)
                yield pa.RecordBatch.from_arrays([ids.take(take), marks.take(take), pa.array(place), pa.array(bt.signed(keys)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], names=["id", "mark", "place", "key", "s1", "s2"])

    return run


def _fetched(shape: Shape):
    """The segments asked for: place, whether its digest is met once, whether its key has too many, suffix,
    reversed text in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "mark", "place", "alone", "hot", "suffix", "front")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            for i, mark, body, wanted in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("body"), batch.column("wanted").to_pylist(), strict=True):
                text = memoryview(body.as_buffer())
                for x in wanted:
                    a, near, far = x["place"] >> 32, x["place"] >> 16 & 0xFFFF, x["place"] & 0xFFFF
                    rows.append((i, mark, x["place"], x["alone"], x["hot"], bytes(text[a : a - near + shape.length]), bytes(text[a - far : a])[::-1]))
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def multikey_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings, and the common prefix of each with the one in front of it (0 first).

    Multikey quicksort on characters of 8 bytes: strings that are still equal are parted by their next
    character, where all groups of one depth go through a single vectorised sort. Strings count as
    padded with zero bytes, also in the common prefixes.
    """
    m = len(strings)
    deep = max(1, -(-max(map(len, strings), default=0) // 8))
    chars = np.frombuffer(b"".join([s.ljust(8 * deep, b"\0") for s in strings]), ">u8").reshape(m, deep)
    order, common = np.arange(m), np.zeros(m, np.int64)
    group = np.zeros(m, np.int64)  # of each place in the order, the place where its group of equals begins
    open_ = np.arange(m) if m > 1 else np.zeros(0, np.int64)
    for d in range(deep):
        if not len(open_):
            break
        word = chars[order[open_], d].astype(np.uint64)
        sort = np.lexsort((word, group[open_]))
        order[open_], word, own = order[open_][sort], word[sort], group[open_]
        same = own[1:] == own[:-1]
        differ = word[1:] ^ word[:-1]
        parted = same & (differ != 0)
        where = open_[1:][parted]
        common[where] = 8 * d + sum((differ[parted] < np.uint64(1 << (64 - 8 * k)) for k in range(1, 8)), np.zeros(len(where), np.int64))
        begins = np.concatenate(([True], ~same | parted))
        group[open_] = open_[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        size = np.diff(np.append(np.flatnonzero(begins), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
    if len(open_):  # equal to the end
        again = open_[1:][group[open_[1:]] == group[open_[:-1]]]
        common[again] = 8 * deep
    return order, common


def repeated_offsets(suffixes: list[bytes], fronts: list[bytes], near: np.ndarray, far: np.ndarray, shape: Shape) -> np.ndarray:
    """For each segment and offset of a window's start in front of the anchor, whether another segment
    has the same window."""
    m = len(suffixes)
    out = np.zeros((m, shape.reach), bool)
    right, shared = multikey_sort(suffixes)
    left, behind = multikey_sort(fronts)
    for o in range(shape.reach):
        live = (near <= o) & (o <= far)
        if live.sum() < 2:
            continue
        a, b = np.empty(m, np.int64), np.empty(m, np.int64)
        a[right] = np.cumsum(shared < shape.length - o)
        b[left] = np.cumsum(behind < o)
        at = np.flatnonzero(live)
        _, which, count = np.unique(a[at] * (m + 1) + b[at], return_inverse=True, return_counts=True)
        out[at, o] = count[which] > 1
    return out


_SPAN = "id bigint, mark bigint, first bigint, last bigint, window binary"


def _spans(i, mark, place: int, offsets: np.ndarray, length: int) -> Iterator[tuple]:
    """The runs of repeated offsets as spans of bytes."""
    a = place >> 32
    on = np.flatnonzero(np.diff(np.concatenate(([0], offsets.astype(np.int8), [0]))))
    for lo, hi in zip(on[::2].tolist(), on[1::2].tolist(), strict=True):
        yield i, mark, a - hi + 1, a - lo + length, None


_FETCHED = "id bigint, mark bigint, place bigint, alone boolean, hot boolean, suffix binary, front binary"


def _rows_out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "mark", "first", "last", "window"])


def _compared(shape: Shape):
    """Spans of windows that repeat in a bucket, which is a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {n: [] for n in ("id", "mark", "place", "alone", "suffix", "front")}
        seen: set[tuple] = set()
        for batch in batches:
            ids, marks, places = (batch.column(n).to_pylist() for n in ("id", "mark", "place"))
            new = []  # rows that repeat hold the same text: one of them is enough
            for k, key in enumerate(zip(ids, marks, places, strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            batch = batch.take(pa.array(new, pa.int64()))
            for n, v in cols.items():
                v += batch.column(n).to_pylist()
        if not cols["id"]:
            return
        place = np.array(cols["place"], np.int64)
        found = repeated_offsets(cols["suffix"], cols["front"], place >> 16 & 0xFFFF, place & 0xFFFF, shape)
        rows: list[tuple] = []
        for k in np.flatnonzero(np.array(cols["alone"], bool) & found.any(axis=1)).tolist():
            rows += _spans(cols["id"][k], cols["mark"][k], int(place[k]), found[k], shape.length)
        if rows:
            yield _rows_out(rows)

    return run


def _windows(shape: Shape):
    """Every window of segments with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, mark, place, suffix, front in zip(*(batch.column(n).to_pylist() for n in ("id", "mark", "place", "suffix", "front")), strict=True):
                text, a, near, far = memoryview(front[::-1] + suffix), place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
                for o in range(near, far + 1):
                    rows.append((i, mark, a - o, a - o + shape.length, xxhash.xxh3_128_digest(text[far - o : far - o + shape.length])))
                if len(rows) >= 20_000:
                    yield _rows_out(rows)
                    rows = []
            if rows:
                yield _rows_out(rows)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans, and the digest of what is left."""
    struct = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    for batch in batches:
        removed, merged_all, shas = [], [], []
        for body, spans in zip(bt.column(batch, "body"), batch.column("spans").to_pylist(), strict=True):
            text = memoryview(body.as_buffer())
            merged: list[list[int]] = []
            for lo, hi in sorted((x["first"], x["last"]) for x in spans or ()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            sha, at = hashlib.sha256(), 0
            for lo, hi in merged:
                sha.update(text[at:lo])
                at = hi
            sha.update(text[at:])
            removed.append(sum(hi - lo for lo, hi in merged))
            merged_all.append([{"first": lo, "last": hi} for lo, hi in merged])
            shas.append(sha.hexdigest())
        sizes = np.diff(bt.raw(bt.column(batch, "body"))[1])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(list(map(len, merged_all)), pa.int64()), pa.array(shas, pa.string()), pa.array(merged_all, pa.list_(struct))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_segments: int = BUCKET_SEGMENTS) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first to last,
    the end excluded)."""
    shape, work = Shape(length), Workspace(spark, "suffix-dedup")
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), body.alias("body")).withColumn("mark", F.xxhash64("body"))
    found = work.write(texts.where(F.octet_length("body") >= length).mapInArrow(bt.lean(_anchored(shape)), "id bigint, mark bigint, place bigint, key bigint, s1 bigint, s2 bigint"), "anchors")
    keys = work.write(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    shared = work.write(found.join(sized(keys, 16, FEW_BYTES), "key", "left_semi"), "shared")
    segments = work.write(shared.groupBy("key", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "place")).alias("one")), "segments")
    window = lambda place: (F.shiftright(place, 32) - F.expr("place & 65535"), F.shiftright(place, 32) - F.expr("(place >> 16) & 65535") + length)
    first, last = window(F.col("place"))
    whole = shared.join(sized(segments.where("n > 1").select("s1", "s2"), 32, FEW_BYTES), ["s1", "s2"], "left_semi").select("id", "mark", first.alias("first"), last.alias("last"))

    # segments to compare: other digests have their key, and not all of these repeat anyway
    open_ = work.write(segments.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("key", (F.col("c") > bucket_segments).alias("hot")), "open")
    wanted = segments.join(sized(open_, 17, FEW_BYTES), "key").select("one.id", "one.mark", F.struct(F.col("one.place").alias("place"), (F.col("n") == 1).alias("alone"), "hot").alias("x"))
    wanted = work.write(wanted.groupBy("id", "mark").agg(F.collect_list("x").alias("wanted")), "wanted")
    total = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).head()[0]
    source = _with(texts, wanted).select("id", "mark", "body", "wanted")
    fetched = work.write(source.mapInArrow(bt.lean(_fetched(shape)), _FETCHED), "fetched")
    buckets = max(1, -(-total // bucket_segments))
    dealt = fetched.where("not hot").drop("hot").repartitionByRange(buckets, F.substring("suffix", 1, shape.key))
    compared = dealt.mapInArrow(bt.lean(_compared(shape)), _SPAN)
    hot = fetched.where("hot").drop("hot")
    if not hot.isEmpty():
        windows = hot.mapInArrow(bt.lean(_windows(shape)), _SPAN).dropDuplicates(["window", "id", "mark", "first"])
        windows = work.write(windows, "windows")
        met = windows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window")
        compared = compared.unionByName(windows.join(met, "window", "left_semi").select("id", "mark", "first", "last", "window"))
    spans = whole.unionByName(compared.drop("window"))
    spans = work.write(spans.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first:bigint,last:bigint>>"
    if spans.count() * 24 > DOCUMENT_BYTES:
        return _with(texts, spans, "left").select("id", "body", "spans").mapInArrow(bt.lean(_cut), out)
    # documents that lose nothing stay where they are
    ids = F.broadcast(spans.select(F.col("id").alias("w_id"), F.col("mark").alias("w_mark")))
    rest = texts.join(ids, texts.id.eqNullSafe(F.col("w_id")) & (texts.mark == F.col("w_mark")), "left_anti").withColumn("spans", F.array().cast("array<struct<first:bigint,last:bigint>>"))
    return _with(texts, spans).select("id", "body", "spans").unionByName(rest.select("id", "body", "spans")).mapInArrow(bt.lean(_cut), out)


def _with(texts: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """texts joined to a written table by id and mark. If the table names few documents, only these are
    shuffled."""
    same = lambda left, i, m: left.id.eqNullSafe(F.col(i)) & (left.mark == F.col(m))
    if how == "inner" and table.count() * 24 <= DOCUMENT_BYTES:
        ids = F.broadcast(table.select(F.col("id").alias("f_id"), F.col("mark").alias("f_mark")))
        texts = texts.join(ids, same(texts, "f_id", "f_mark"), "left_semi")
    table = table.withColumnsRenamed({"id": "w_id", "mark": "w_mark"})
    return texts.join(table, same(texts, "w_id", "w_mark"), how)
