"""Quality and toxicity on held-out rows, compaction, and the pipeline."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelode.llm import compaction
from tidelode.llm import quality as q
from tidelode.llm import toxicity as tox
from tidelode.llm.queries import ORACLE_SQL, QUERIES
from tidelode.llm.workspace import Workspace

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def places():
    """Host and path of documents without a URL."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def halves(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return spark.read.parquet(f"{SF}/documents.parquet"), labels.where(part == 0), labels.where(part == 1)


# ---- quality


@tables
def test_quality_held_out(spark):
    docs, train, test = halves(spark)
    rows = test.join(q.quality(spark, docs, train, *places()), "doc_id").collect()
    assert np.mean([(r.quality == 1) == r.keep for r in rows]) >= 0.97
    assert np.mean([r.keep for r in rows if r.quality == 1]) >= 0.98


def test_quality_edges(spark, edge, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = q.quality(spark, edge, none, *places()).collect()
    assert len(rows) == len(edge_rows) and {round(r.evidence, 9) for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 1), (12, 0), (13, 0), (9, 1), (100, 1), (None, 1), (101, None), (1, 1)], "doc_id long, quality int")
    rows = q.quality(spark, edge, labels, *places()).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.posterior <= 1 for r in rows)
    left = q.good_documents(spark, edge, labels, *places())
    assert left.columns == edge.columns and left.count() == sum(r.keep for r in rows)
    assert q.quality(spark, edge.limit(0), labels, *places()).count() == 0


def test_shrinkage(spark):
    """A path of one document moves its documents less than one of many; posteriors follow the formula."""
    good, bad = "plain words of a text here", "#### $$$$ &&&& ####"
    rows = [(k, good if k % 2 else bad, "mixed", "a") for k in range(40)] + [(100 + k, bad, "bad", "b") for k in range(40)] + [(200, good, "bad", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = docs.select("doc_id", (F.col("text") == good).cast("int").alias("quality"))
    got = {r.doc_id: r for r in q.quality(spark, docs, labels, F.col("host"), F.col("path")).collect()}
    assert got[100].path_mean < got[200].path_mean < got[1].path_mean
    n, total = len(rows), sum(r.evidence for r in got.values())
    odds = lambda p: math.log(p / (1 - p))
    for r in (got[1], got[200]):
        want = 1 / (1 + math.exp(-(odds(r.evidence) + odds(min(max(r.path_mean, 1e-6), 1 - 1e-6)) - odds(total / n))))
        assert r.posterior == pytest.approx(want, rel=1e-6)


def test_url_parts(spark):
    host, path = q.url_parts("u")
    rows = spark.createDataFrame([("https://A.example.com/x/1?q=2",), (None,), ("no url",)], "u string").select(host.alias("h"), path.alias("p")).collect()
    assert tuple(rows[0]) == ("a.example.com", "/x/1") and tuple(rows[1]) == (None, None) and rows[2].h is None


# ---- toxicity


@tables
def test_toxicity_held_out(spark):
    docs, train, test = halves(spark)
    grade = (F.col("toxic") * (2 - F.col("quality"))).alias("grade")
    rows = test.join(tox.toxicity(spark, docs, train.select("doc_id", grade)).withColumnRenamed("toxic", "flag"), "doc_id").collect()
    assert np.mean([r.flag for r in rows if not r.toxic]) <= 0.02
    assert np.mean([r.expected_severity for r in rows if r.toxic]) > 4 * np.mean([r.expected_severity for r in rows if not r.toxic])


def test_toxicity_learns_grades(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        g = int(rng.integers(0, 3))
        words = [f"w{x}" for x in rng.integers(0, 300, 30)] + ["mild"] * (g >= 1) + ["awful"] * (g == 2)
        rows.append((k, " ".join(words), g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    got = docs.withColumnRenamed("grade", "true").drop("text").join(tox.toxicity(spark, docs, docs.where("doc_id < 400")), "doc_id").where("doc_id >= 400").collect()
    assert np.mean([r.true == r.grade for r in got]) > 0.95
    assert all(r.at_least[0] >= r.at_least[1] and r.expected_severity == pytest.approx(sum(r.at_least)) for r in got)


def test_toxicity_edges(spark, edge, edge_rows):
    grades = lambda rows: spark.createDataFrame(rows, "doc_id long, grade int")
    assert {r.expected_severity for r in tox.toxicity(spark, edge, grades([])).collect()} == {0.0}
    assert {r.expected_severity for r in tox.toxicity(spark, edge, grades([(1, 2), (9, 2)])).collect()} == {2.0}
    rows = tox.toxicity(spark, edge, grades([(1, 0), (2, 0), (9, 1), (100, 1), (None, 1), (101, None)])).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in edge_rows)
    assert tox.toxicity(spark, edge.limit(0), grades([(1, 0)])).count() == 0


# ---- compaction


def test_compaction(spark):
    table = compaction.ShardedTable(spark, Workspace(spark, "test-shards").at("t"), target=400_000, fanout=3)
    for k in range(6):
        table.append(spark.range(k * 1000, (k + 1) * 1000, 1, 4).withColumn("x", F.md5(F.col("id").cast("string"))))
        table.compact()
    live = table.shards()
    assert len(live) < 12 and sum(s.rows for s in live) == 6000 and not table.plan(live)
    assert table.read().distinct().count() == 6000
    assert table.read(1).count() == 1000  # old versions stay readable until they are cleared away
    with pytest.raises(compaction.ConflictError):
        table.commit(2, [])
    assert table.vacuum() and table.read().count() == 6000
    table.append(spark.range(0).withColumn("x", F.lit("")))
    assert table.shards() == live


def test_writers_and_vacuum(spark, monkeypatch):
    """A vacuum between a writer's files and its commit spares them; of a writer that fails they go."""
    root = Workspace(spark, "test-writers").at("t")
    one, two = compaction.ShardedTable(spark, root), compaction.ShardedTable(spark, root)
    one.append(spark.range(10))
    commit, met = compaction.ShardedTable.commit, []

    def late(table, base, shards):
        if table is one and not met:  # the other writer is first, and clears the table
            met.append(two.append(spark.range(100, 110)))
            met.append(two.vacuum())
        return commit(table, base, shards)

    monkeypatch.setattr(compaction.ShardedTable, "commit", late)
    assert one.append(spark.range(50, 55)) == 3 and met == [2, []]
    assert sorted(r.id for r in one.read().collect()) == [*range(10), *range(50, 55), *range(100, 110)]

    def failing(table, base, shards):
        raise RuntimeError("the writer is lost")

    monkeypatch.setattr(compaction.ShardedTable, "commit", failing)
    with pytest.raises(RuntimeError):
        two.append(spark.range(5))
    monkeypatch.setattr(compaction.ShardedTable, "commit", commit)
    assert len(one.vacuum()) >= 1 and one.read().count() == 25
    folder = "shards/left"
    one._written(spark.range(3).coalesce(1), folder)  # a writer that is gone without giving its claim up
    assert not one.vacuum()
    monkeypatch.setattr(compaction, "CLAIM_SECONDS", -10)
    assert len(one.vacuum()) == 1 and one.read().count() == 25


def test_compaction_edges(spark, edge, edge_rows):
    rows = compaction.sharded(spark, edge, arrivals=3).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in rows) == Counter((i, len((t or "").encode())) for i, t in edge_rows)
    assert compaction.sharded(spark, edge.limit(0)).count() == 0


# ---- queries and pipeline


@tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    small = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, small)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    found = c.execute(ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    want = Counter(tuple(r[cols.index(k)] for k in sorted(cols)) for r in found.fetchall())
    assert Counter(tuple(r[k] for k in sorted(df.columns)) for r in df.collect()) == want


@tables
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work, now, left = Workspace(spark, "test-pipeline"), docs, {}
    for name, stage in p.STAGES[:-1]:
        after = work.write(stage(spark, now, SF), name)
        assert after.columns == docs.columns
        assert after.join(now, "doc_id", "left_anti").isEmpty()
        left[name] = {r.doc_id for r in after.select("doc_id").collect()}
        now = after
    sizes = [docs.count(), *map(len, left.values())]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    last = p.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in last} == left["decontamination"] and all(r.exact for r in last)
    assert {r.doc_id for r in p.run(spark, SF).collect()} == left["decontamination"]
