"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

Grades 0, 1, ..., K share one weight vector: P(grade >= k) = sigmoid(w x - cut_k) with rising cuts. A
document's features say which hashed words and beginnings of words it holds, and how often. The expected severity is the sum of P(grade >= k) over
k from 1 to K.

The model is fitted on a bounded sample of labelled rows (`most_labels`, drawn by hash). Words enter it if
their presence differs between grade 0 and above by more than chance; the rest would add noise that grows
with a text's length. Every document is scored, whole, in one pass without a shuffle.

Defined cases: null and empty texts have no features and get the severity of the cuts alone; with labels of
a single grade (or none) every document has that grade (or 0); rows that repeat are each returned; an empty table
gives no rows. A very long text is read whole by one task, a slice of its own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt

#: Labelled rows on which the model is fitted at most, buckets of hashed words, and the least z-value of a
#: word's association that takes it into the model.
MOST_LABELS, BUCKETS, LEAST_Z = 10_000, 1 << 20, 4.0
#: Bytes of beginnings of words, and how often a text holds a feature.
PREFIXES, TIMES = (4, 6, 8), (1, 2, 4)
#: A document is toxic from this probability of grade 1 or above.
TOXIC = 0.5


def word_buckets(part: bt.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, bucket) of the features of a slice.

    A feature is a word, or one of its beginnings of PREFIXES bytes, that the text holds at least 1, 2 or
    4 times.
    """
    w = bt.words(part, bt.ALNUM)
    if not len(w.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(part.starts) - 1), np.diff(w.rows))
    low, long = bt.LOWER[part.data], w.ends - w.starts
    own, rows, head = [w.hashes], [row], np.zeros(len(w.hashes), np.uint64)
    for k in range(max(PREFIXES)):
        inside = long > k
        head[inside] += bt.BYTE_KEY[low[w.starts[inside] + k]] * bt.place_keys(k + 1)[k]
        if k + 1 in PREFIXES:
            own.append(bt.splitmix(head[inside] + np.uint64(k << 8)))
            rows.append(row[inside])
    key, times = np.unique(np.concatenate(rows) << 32 | (np.concatenate(own) & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
    levels = [np.unique((k >> 32) << 20 | (bt.splitmix((k & 0xFFFFFFFF).astype(np.uint64) + np.uint64(t << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64)) for t, k in ((t, key[times >= t]) for t in TIMES)]
    key = np.unique(np.concatenate(levels))
    return key >> 20, key & (BUCKETS - 1)


class OrdinalModel:
    """Weights over hashed words and the cuts between grades."""

    def __init__(self, rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray, ridge: float = 1e-4, rounds: int = 300):
        """rows and buckets are the sparse features of the texts with those grades."""
        self.levels = int(grades.max()) if len(grades) else 0
        self.constant = self.levels if len(grades) and len(np.unique(grades)) == 1 else None
        self.weights = np.zeros(BUCKETS, np.float32)
        self.cuts = np.zeros(0)
        if self.levels == 0 or self.constant is not None:
            return
        n, up = len(grades), grades > 0
        all_, bad = np.bincount(buckets, minlength=BUCKETS), np.bincount(buckets[up[rows]], minlength=BUCKETS)
        share = up.mean()
        z = (bad - all_ * share) / np.sqrt(np.maximum(all_ * share * (1 - share) * (1 - all_ / n), 1e-9) + 0.25)
        chosen = np.flatnonzero(np.abs(z) >= LEAST_Z)
        column = np.full(BUCKETS, -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        keep = column[buckets] >= 0
        r, c = rows[keep], column[buckets[keep]]
        at_least = np.array([(grades >= k).mean() for k in range(1, self.levels + 1)])
        cut = np.log((1 - at_least + 1 / n) / (at_least + 1 / n))
        # cuts rise: the first as it is, then steps as exponents
        par = np.concatenate((np.zeros(len(chosen)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))))
        m1, m2 = np.zeros_like(par), np.zeros_like(par)
        k, every = len(chosen), np.arange(n)
        for t in range(1, rounds + 1):  # full-batch Adam
            w = par[:k]
            cuts = np.cumsum(np.concatenate((par[k : k + 1], np.exp(par[k + 1 :]))))
            x = np.bincount(r, w[c], minlength=n) if len(r) else np.zeros(n)
            p = 1 / (1 + np.exp(-np.clip(x[:, None] - cuts, -35, 35)))  # P(grade >= 1..K)
            edge = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
            mass = np.maximum(edge[every, grades] - edge[every, grades + 1], 1e-12)
            slope = edge * (1 - edge)
            dx = -(slope[every, grades] - slope[every, grades + 1]) / mass
            dcut = np.zeros((n, self.levels + 2))
            np.add.at(dcut, (every, grades), slope[every, grades] / mass)
            np.add.at(dcut, (every, grades + 1), -slope[every, grades + 1] / mass)
            dc = dcut[:, 1:-1].sum(axis=0) / n
            tail = np.cumsum(dc[::-1])[::-1]
            grad = np.concatenate((np.bincount(c, dx[r], minlength=k) / n + ridge * w if k else w, tail[:1], tail[1:] * np.exp(par[k + 1 :])))
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            par = par - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        self.weights[chosen] = par[:k]
        self.cuts = np.cumsum(np.concatenate((par[k : k + 1], np.exp(par[k + 1 :]))))

    def at_least(self, part: bt.Slice) -> np.ndarray:
        """For each text of a slice P(grade >= 1), ..., P(grade >= K)."""
        n = len(part.starts) - 1
        if self.constant is not None:
            return np.ones((n, self.constant))
        rows, buckets = word_buckets(part)
        x = np.bincount(rows, self.weights[buckets], minlength=n)
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.cuts, -35, 35)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bt.slices(bt.column(batch, "text")):
            rows, buckets = word_buckets(part)
            cut = np.searchsorted(rows, np.arange(len(part.starts)))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(part.lo, part.hi - part.lo), lists], names=["grade", "words"])


def fit(spark: SparkSession, docs: DataFrame, grades: DataFrame, id_col: str, text_col: str, most_labels: int) -> OrdinalModel:
    """The model of grades(doc_id, grade), on at most about most_labels rows chosen by hash."""
    own = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    n = own.count()
    if n > most_labels:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * most_labels / n))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "doc_id").select("grade", "text").mapInArrow(bt.lean(_sparse), "grade int, words array<int>")
    got = rows.toArrow()
    words = got.column("words").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    sizes = np.diff(words.offsets.to_numpy()) if len(words) else np.zeros(0, np.int64)
    return OrdinalModel(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), words.flatten().to_numpy(), np.maximum(got.column("grade").to_numpy(), 0).astype(np.int64))


def _scored(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bt.slices(bt.column(batch, "text")):
                p = model.at_least(part)
                n = len(p)
                grade = (p >= 0.5).sum(axis=1) if p.shape[1] else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(part.lo, part.hi - part.lo), pa.array(p.sum(axis=1)), pa.array(grade.astype(np.int32)),
                    pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(p[:, 0] >= TOXIC if p.shape[1] else np.zeros(n, bool)),
                ], names=["doc_id", "expected_severity", "grade", "at_least", "toxic"])

    return run


def toxicity(spark: SparkSession, docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS) -> DataFrame:
    """One row for each document: doc_id, expected_severity, grade (of median severity), at_least
    (P(grade >= k) for k from 1), toxic. grades holds doc_id and an integer grade from 0."""
    model = fit(spark, docs, grades, id_col, text_col, most_labels)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(bt.lean(_scored(model)), f"doc_id {dict(rows.dtypes)['doc_id']}, expected_severity double, grade int, at_least array<double>, toxic boolean")
