"""Quality of documents: a classifier's evidence, and hierarchical empirical Bayes over hosts and paths.

A logistic regression on features of the text gives each document its own probability of good quality.
Hosts and the paths in them have Beta posteriors of their mean evidence: a path is shrunk toward its host
and a host toward all documents, by strengths that the spread between groups sets (method of moments), so
a path with few documents says little. The posterior of a document's path, without the document itself,
replaces the base rate in its log-odds.

Only groups are aggregated, with partial sums before each shuffle, so a host of any size is no hot spot.
The classifier alone is fitted on a bounded sample of labelled rows (`most_labels`, drawn by hash); group
statistics cover all documents.

Defined cases: a null text counts as empty; null hosts and paths form a group each; with fewer than two
labelled classes every document has the same evidence, the share of good labels (one half without any);
rows that repeat count as often as they occur; an empty table gives no rows. A very long text is read whole by one
task, in a slice of its own. Other columns are not read; good_documents returns all of them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.workspace import Workspace, sized

#: Labelled rows on which the classifier is fitted at most.
MOST_LABELS = 20_000
#: Bounds of a group's prior strength, in documents.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: A document is kept from this posterior on.
KEEP = 0.5


def _class(*members: int | range) -> np.ndarray:
    table = np.zeros(256, np.int32)
    for m in members:
        table[m if isinstance(m, int) else list(m)] = 1
    return table


_CLASSES = {
    "upper": _class(range(0x41, 0x5B)),
    "lower": _class(range(0x61, 0x7B)),
    "digit": _class(range(0x30, 0x3A)),
    "space": _class(0x20, range(0x09, 0x0E)),
    "line": _class(0x0A),
    "stop": _class(*map(ord, ".,;:?'\"()-")),
    "bar": _class(ord("|")),
    "markup": _class(*map(ord, "<>{}[]=/\\_")),
    "symbol": _class(*map(ord, "#$%&*!@^~+`")),
    "beyond": _class(range(0x80, 0x100)),
}
N_FEATURES = len(_CLASSES) + 7


def features(part: bt.Slice) -> np.ndarray:
    """A row of features for each text: shares of byte classes, word lengths, repetition, size."""
    size = np.diff(part.starts).astype(np.float64)
    some = np.maximum(size, 1)
    cols = []
    for table in _CLASSES.values():
        total = np.concatenate(([0], np.cumsum(table[part.data], dtype=np.int64)))
        cols.append((total[part.starts[1:]] - total[part.starts[:-1]]) / some)
    w = bt.words(part, bt.SPACED)
    count = np.diff(w.rows).astype(np.float64)
    again = np.concatenate(([0, 0], np.cumsum(w.hashes[1:] == w.hashes[:-1]))) if len(w.hashes) else np.zeros(1, np.int64)
    twice = np.array([again[hi] - again[min(lo + 1, hi)] for lo, hi in zip(w.rows[:-1], w.rows[1:], strict=True)], np.float64)
    kinds = np.array([len(np.unique(w.hashes[lo:hi])) for lo, hi in zip(w.rows[:-1], w.rows[1:], strict=True)], np.float64)
    n = np.maximum(count, 1)
    upper, lower, symbol = cols[0], cols[1], cols[8]
    cols += [twice / n, kinds / n, kinds / np.maximum(n, 1) ** 0.7, size / n / 10, np.log1p(count) / 5, upper / np.maximum(upper + lower, 1e-9), np.sqrt(symbol)]
    return np.stack(cols, axis=1)


class Classifier:
    """A ridge logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.base = float(y.mean()) if len(y) else 0.5
        self.weights = None
        if len(y) and 0 < self.base < 1:
            self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
            z = self._design(x)
            w = np.zeros(z.shape[1])
            w[0] = np.log(self.base / (1 - self.base))
            penalty = np.full(z.shape[1], ridge)
            penalty[0] = 0
            for _ in range(30):  # Newton's method
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
                w += np.clip(step, -5, 5)
                if np.abs(step).max() < 1e-6:
                    break
            self.weights = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), z, z * z], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -12, 12)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bt.slices(bt.column(batch, "text")):
            x = features(part)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(part.lo, part.hi - part.lo), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labels: int) -> Classifier:
    """The classifier of labels(doc_id, quality), on at most about most_labels rows chosen by hash."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    n = good.count()
    if n > most_labels:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * most_labels / n))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(good), "doc_id").select("label", "text").mapInArrow(bt.lean(_features), "label double, x array<double>")
    got = rows.toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    return Classifier(x, (got.column("label").to_numpy() > 0).astype(np.float64))


def _scored(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bt.slices(bt.column(batch, "text")):
                rest = batch.slice(part.lo, part.hi - part.lo)
                yield pa.RecordBatch.from_arrays([*(rest.column(k) for k in ("doc_id", "host", "path", "mark")), pa.array(model.probability(features(part)))], names=["doc_id", "host", "path", "mark", "evidence"])

    return run


def _strength(groups: DataFrame, mean: str) -> float:
    """The prior strength, in documents, that the spread of group means around their prior means sets."""
    spread = F.sum(F.col("n") * (F.col("total") / F.col("n") - F.col(mean)) ** 2)
    within = F.sum(F.col("squares") - F.col("total") ** 2 / F.col("n"))
    n, k, between, inside, of = groups.agg(F.sum("n"), F.count("*"), spread, within, F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean)))).head()
    if not n or k < 2 or n <= k:
        return STRONGEST
    noise = inside / (n - k)
    tau = (between - k * noise) / n
    return float(np.clip(of / n / tau - 1 if tau > 0 else STRONGEST, WEAKEST, STRONGEST))


def url_parts(url: str) -> tuple[F.Column, F.Column]:
    """Host and path of a column of URLs, for docs that have one."""
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.try_parse_url(F.col(url), F.lit("PATH"))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: F.Column, path: F.Column, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS, keep: float = KEEP) -> DataFrame:
    """One row for each document: doc_id, host, path, evidence, host_mean, path_mean, posterior, keep, mark.

    mark is the xxhash64 of the text; with doc_id it finds the row again.
    """
    work = Workspace(spark, "quality")
    model = fit(spark, docs, labels, id_col, text_col, most_labels)
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    seen = work.write(rows.mapInArrow(bt.lean(_scored(model)), f"doc_id {kinds['doc_id']}, host {kinds['host']}, path {kinds['path']}, mark bigint, evidence double"), "evidence")
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") ** 2).alias("squares")]
    paths = work.write(seen.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    n, total = hosts.agg(F.sum("n"), F.sum("total")).head()
    mean = (total or 0.0) / (n or 1) if n else model.base
    hosts = hosts.withColumn("mean", F.lit(float(mean)))
    of_host = _strength(hosts, "mean")
    hosts = work.write(hosts.select(F.col("host").alias("h"), ((F.col("total") + of_host * F.col("mean")) / (F.col("n") + of_host)).alias("host_mean")), "hosts")
    paths = work.write(paths.join(sized(hosts, 128), F.col("host").eqNullSafe(F.col("h")), "left").drop("h"), "path-means")
    of_path = _strength(paths, "host_mean")
    paths = paths.withColumnsRenamed({"host": "h", "path": "p"}).drop("squares")
    joined = seen.join(sized(paths, 256), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    prior = (F.col("total") - F.col("evidence") + of_path * F.col("host_mean")) / (F.col("n") - 1 + of_path)
    odds = lambda p: F.log(p / (1 - p))
    safe = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    base = float(np.clip(mean, 1e-6, 1 - 1e-6))
    logit = odds(safe(F.col("evidence"))) + odds(safe(F.col("path_mean"))) - float(np.log(base / (1 - base)))
    return joined.withColumn("path_mean", prior).withColumn("posterior", 1 / (1 + F.exp(-logit))).select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", "posterior", (F.col("posterior") >= keep).alias("keep"), "mark")


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: F.Column, path: F.Column) -> DataFrame:
    """docs without the rows that are not kept."""
    work = Workspace(spark, "quality-rejected")
    gone = work.write(quality(spark, docs, labels, host, path).where("not keep").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "gone")
    gone = sized(gone, 32)
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.gone_id) & (F.xxhash64(docs.text) == gone.gone_mark), "left_anti")
