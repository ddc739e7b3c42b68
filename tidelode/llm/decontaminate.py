"""Benchmark decontamination: an FM-index over each shard of the corpus, searched for all test phrases.

A window is `size` consecutive words of a benchmark item, or the whole of a shorter item. Each task makes
shards of the documents that it reads. A shard holds, as symbols, the chains of words whose neighbouring
pairs all stand in some window: every occurrence of a window is inside such a chain, so nothing is lost,
and the index stays small. Windows are searched backwards through the ranks of a wavelet matrix, located
by sampled suffix positions, and their occurrences merged to spans of words and bytes to remove.

Documents are read once for each block of the benchmark and never shuffled; a block has a bounded number
of bytes, and a benchmark of one block needs no later step. Words are compared by 64-bit hashes.

Defined cases: null and empty texts have no words; an item without words has no window; items that repeat
an item_id count as one item; an item with a null item_id marks words but is in no list of items; rows
that repeat are each returned; empty tables give no rows or clean rows. A very long text is searched whole by one
task, in a slice of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.fm_index import FmIndex

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that are searched for at once.
BLOCK_BYTES = 8 << 20
#: Symbols of a shard's index.
SHARD_SYMBOLS = 1_000_000

_SEPARATOR = 1
_OUT = "id bigint, digest binary, n_words bigint, spans array<struct<lo:bigint,hi:bigint,first:bigint,last:bigint>>, items array<string>"


class Phrases:
    """The windows of a block of items, by length, with the vocabulary and neighbour pairs in them."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        texts = pa.array([t for _, t in items], pa.large_string())
        for part in bt.slices(texts):
            w = bt.words(part, bt.ALNUM)
            for k, (lo, hi) in enumerate(zip(w.rows[:-1], w.rows[1:], strict=True)):
                h = w.hashes[lo:hi].tolist()
                name = items[part.lo + k][0]
                for at in range(max(1, len(h) - size + 1) if h else 0):
                    found[tuple(h[at : at + size])].update([] if name is None else [name])
        self.vocabulary = np.unique(np.array([x for k in found for x in k], np.uint64))
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for k in found:
            by_length[len(k)].append(k)
        self.groups: list[tuple[np.ndarray, list[list[str]]]] = []
        pairs = [np.zeros(0, np.int64)]
        single = np.zeros(len(self.vocabulary) + 2, bool)
        for long, keys in sorted(by_length.items()):
            ids = np.searchsorted(self.vocabulary, np.array(keys, np.uint64)) + 2
            self.groups.append((ids, [sorted(found[k]) for k in keys]))
            pairs += [ids[:, k] * self.symbols + ids[:, k + 1] for k in range(long - 1)]
            if long == 1:
                single[ids[:, 0]] = True
        self.pairs, self.single = np.unique(np.concatenate(pairs)), single
        self.shortest = min((x for x in by_length if x > 1), default=2)

    @property
    def symbols(self) -> int:
        return len(self.vocabulary) + 2

    def chains(self, w: bt.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that may be in an occurrence: their place, their symbol, and whether a chain begins."""
        none = np.zeros(0, np.int64)
        n = len(w.hashes)
        if not n or not len(self.vocabulary):
            return none, none, none.astype(bool)
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == w.hashes, at + 2, 0)
        linked = np.zeros(n + 1, bool)  # the word in front and this one are a pair of some window
        if len(self.pairs):
            pair = symbol[:-1] * self.symbols + symbol[1:]
            spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked[1:n] = (self.pairs[spot] == pair) & (symbol[:-1] > 0) & (symbol[1:] > 0)
            linked[w.rows[w.rows < n]] = False
        first = ~linked[:n]
        chain = np.cumsum(first) - 1
        long = np.bincount(chain)[chain]
        keep = (long >= self.shortest) | self.single[symbol]
        place = np.flatnonzero(keep)
        return place, symbol[keep], first[keep] | ~np.concatenate(([False], keep[:-1]))[keep]


class Shard:
    """Documents of a task that have chains, until their index is built and searched."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.rows: list[tuple] = []
        self.symbols: list[np.ndarray] = []
        self.origin: list[np.ndarray] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, row: tuple, place: np.ndarray, symbol: np.ndarray, begins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        lead = np.flatnonzero(begins)
        self.symbols.append(np.insert(symbol, lead, _SEPARATOR))
        self.origin.append(np.stack([np.full(len(self.symbols[-1]), len(self.rows)), np.insert(place, lead, -1)]))
        self.rows.append(row)
        self.words.append((starts, ends))
        self.size += len(self.symbols[-1])

    def results(self) -> Iterator[tuple]:
        index = FmIndex(np.concatenate(self.symbols), self.phrases.symbols)
        doc, place = np.concatenate(self.origin, axis=1)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for ids, names in self.phrases.groups:
            lo, hi = index.search(ids)
            hits = hi - lo
            which = np.repeat(np.arange(len(ids)), hits)
            rows = np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(int(hits.sum()))
            at = index.locate(rows)
            for k, d, p in zip(which.tolist(), doc[at].tolist(), place[at].tolist(), strict=True):
                spans[d].append((p, p + ids.shape[1]))
                items[d].update(names[k])
        for d, (i, digest, n) in enumerate(self.rows):
            starts, ends = self.words[d]
            merged: list[list[int]] = []
            for lo, hi in sorted(spans[d]):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            yield i, digest, n, [{"lo": lo, "hi": hi, "first": int(starts[lo]), "last": int(ends[hi - 1])} for lo, hi in merged], sorted(items[d])


def _searched(phrases: Phrases):
    struct = pa.struct([(k, pa.int64()) for k in ("lo", "hi", "first", "last")])
    kinds = (("id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("spans", pa.list_(struct)), ("items", pa.list_(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = Shard(phrases), []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for part in bt.slices(bt.column(batch, "text")):
                w = bt.words(part, bt.ALNUM)
                place, symbol, begins = phrases.chains(w)
                cuts = np.searchsorted(place, w.rows)
                for k in range(part.hi - part.lo):
                    lo, hi = w.rows[k], w.rows[k + 1]
                    row = (ids[part.lo + k], xxhash.xxh3_128_digest(part.data[part.starts[k] : part.starts[k + 1]].tobytes()), int(hi - lo))
                    a, b = cuts[k], cuts[k + 1]
                    if a == b:
                        rows.append((*row, [], []))
                    else:
                        shard.add(row, place[a:b] - lo, symbol[a:b], begins[a:b], (w.starts[lo:hi] - part.starts[k]).copy(), (w.ends[lo:hi] - part.starts[k]).copy())
                if shard.size >= SHARD_SYMBOLS:
                    rows += shard.results()
                    shard = Shard(phrases)
                if len(rows) >= 5000:
                    yield out()
                    rows = []
        if shard.rows:
            rows += shard.results()
        if rows:
            yield out()

    return run


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    spans are the merged runs of hit words: word numbers lo to hi, bytes first to last (ends excluded).
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-total // block_bytes))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        phrases = Phrases([(r.name, r.text) for r in block.distinct().collect()], size)
        part = texts.mapInArrow(bt.lean(_searched(phrases)), _OUT)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:  # rows of one document meet, and as many come out as went in for each block
        met = found.groupBy("id", "digest").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / blocks).cast("int").alias("copies"))
        found = met.withColumn("spans", _merged()).select("id", "digest", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x.hi - x.lo)
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def _merged() -> F.Column:
    """Sorted spans of several blocks with those that meet made one."""
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint,first:bigint,last:bigint>>")
    last = lambda done: F.element_at(done, -1)
    joined = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done).lo.alias("lo"), F.greatest(last(done).hi, x.hi).alias("hi"), last(done).first.alias("first"), F.greatest(last(done)["last"], x["last"]).alias("last"))))
    return F.aggregate(F.array_sort("spans"), empty, lambda done, x: F.when((F.size(done) > 0) & (x.lo <= F.try_element_at(done, F.lit(-1)).hi), joined(done, x)).otherwise(F.concat(done, F.array(x))))


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated ones. Where doc_ids repeat or are null each row counts by itself."""
    from tidelode.llm.workspace import Workspace, row_keyed, sized

    work = Workspace(spark, "decontaminate")
    rows, key = row_keyed(docs, work)
    gone = work.write(contamination(spark, rows, benchmark, key).where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return rows.join(sized(gone, 24), key, "left_anti").select(*docs.columns)


def items_digest(items: list[str]) -> str:
    """What op10 returns for a list of items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
