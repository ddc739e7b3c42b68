"""Draws from logits, the training cursor, ranks in buffers, observed writes, bucketed joins, reduced cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelode.functions import logits as L
from tidelode.operators import crystal, joins, neighbours, ranking, reduction, sampling
from tidelode.plans import draws


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head()[0]


def arr(*v):
    return F.array(*[F.lit(x).cast("double") for x in v])


def test_logits(spark):
    assert one(spark, L.masked(arr(1.0, float("nan"), None, 4.0), 3)) == [1.0, None, None, None]
    assert one(spark, L.top_k(arr(3.0, 1.0, 2.0, 2.0, None), F.lit(2))) == [3.0, None, 2.0, 2.0, None]
    assert one(spark, L.top_k(arr(3.0, 1.0), F.lit(0))) == [3.0, 1.0] == one(spark, L.top_k(arr(3.0, 1.0), F.lit(9)))
    p = one(spark, L.softmax(arr(1000.0, 999.0, None, -1000.0), F.lit(0.5)))
    assert p == pytest.approx([1 / (1 + math.exp(-2)), 1 / (1 + math.exp(2)), 0, 0])
    assert one(spark, L.softmax(F.lit(None).cast("array<double>"), F.lit(1.0))) is None
    assert one(spark, L.softmax(arr(None, None), F.lit(1.0))) == [0.0, 0.0]
    s = one(spark, L.sigmoid_top_k(arr(800.0, -800.0, 0.0), F.lit(2)))
    assert s == [1.0, 0.0, 0.5]


def test_draws_follow_the_cumulative_sum(spark):
    p = arr(0.0, 0.25, 0.0, 0.5, 0.25, 0.0)
    got = [one(spark, L.drawn(p, F.lit(u))) for u in (0.0, 0.2499, 0.25, 0.74, 0.75, 0.9999999999999999)]
    assert got == [1, 1, 3, 3, 4, 4]
    assert one(spark, L.drawn(arr(0.3, 0.3, 0.0), F.lit(0.99))) == 1  # rounding leaves the sum below the number
    assert one(spark, L.drawn(arr(0.0, 0.0), F.lit(0.1))) is None and one(spark, L.drawn(F.lit(None).cast("array<double>"), F.lit(0.1))) is None


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_cursor_is_a_permutation(spark, n):
    rows = spark.range(2 * n).select(F.floor(F.col("id") / n).alias("e"), (F.col("id") % n).alias("p"))
    got = rows.select("e", "p", sampling.row_at(F.col("e"), F.col("p"), F.lit(n), 7).alias("r")).collect()
    by = {e: [r.r for r in sorted(got, key=lambda r: r.p) if r.e == e] for e in (0, 1)}
    assert sorted(by[0]) == sorted(by[1]) == list(range(n))
    if n >= 16:
        assert by[0] != by[1] and by[0] != list(range(n))
        assert sum(abs(a - b) == 1 for a, b in zip(by[0], by[0][1:], strict=False)) < n / 4


def test_cursor_far_out(spark):
    n = 10**15
    got = spark.range(50).select(sampling.row_at(F.lit(3), F.col("id") * 7 + 10**14, F.lit(n), 1).alias("r")).collect()
    assert len({r.r for r in got}) == 50 and all(0 <= r.r < n for r in got)
    assert one(spark, sampling.row_at(F.lit(0), F.lit(5), F.lit(5), 1)) is None


def test_cursor_goes_on(spark):
    table = spark.range(23).select(F.col("id").alias("number"), (F.col("id") * 10).alias("doc"))
    whole = [tuple(r) for r in sampling.epoch_rows(table, "number", 23, 5, 0, 60).orderBy("step").collect()]
    assert [r[1] for r in whole] == list(range(60)) and [r[2] for r in whole] == [k // 23 for k in range(60)]
    parts = [tuple(r) for k in range(0, 60, 13) for r in sampling.epoch_rows(table, "number", 23, 5, k, min(13, 60 - k)).orderBy("step").collect()]
    assert parts == whole
    assert sampling.epoch_rows(table.limit(0), "number", 0, 5, 0, 9).collect() == []


@pytest.mark.parametrize("ids", [list(range(7)), list(range(9)), [3, None, 1], [4]])
def test_cursor_of_odd_tables_like_its_sql(spark, tmp_path, ids):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = draws.epoch_cursor(spark, f"file://{tmp_path}")
    want = c.execute(f"select {', '.join(df.columns)} from ({draws.ORACLE_SQL['epoch_cursor']}) order by step").fetchall()
    assert [tuple(r) for r in df.orderBy("step").collect()] == want


def plain_ranks(rows, buffer):
    out = {}
    for k, key, v in rows:
        own = [x for g, x in buffer if g == key and x is not None]
        out[k] = None if v is None or not own else 0.5 if len(own) == 1 else sum(x < v for x in own) / (len(own) - 1)
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_ranks_in_buffers(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "MOST_BUFFER", most)  # with 3, by a sort of both
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", "one", "none", None]), rng.choice([None, *[x / 4 for x in range(-20, 60)]])) for k in range(300)]
    buffer = [(rng.choice(["x", "y", None]), rng.choice([None, *[x / 2 for x in range(20)]])) for _ in range(120)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "k int, key string, v double").repartition(4)
    got = ranking.percentile_rank_in(df, spark.createDataFrame(buffer, "key string, v double"), ["key"], "v")
    if most > 3:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "rangepartitioning" not in plan and plan.count("BroadcastExchange") == 1
    assert {r.k: r.pr for r in got.collect()} == plain_ranks(rows, buffer)
    assert ranking.percentile_rank_in(df, spark.createDataFrame([], "key string, v double"), ["key"], "v").where("pr is not null").count() == 0


def test_counts_are_taken_while_writing(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            met.add(len(b))
            yield b

    rows = spark.createDataFrame([(k, r) for k, r in enumerate([None, "gate_failed", "missing_score", None, "gate_failed"])], "k int, drop_reason string")
    rows = rows.mapInPandas(seen, rows.schema)
    got = joins.write_candidates(rows, f"file://{tmp_path}/c")
    assert got == {"total": 5, "kept": 2, "invalid_or_mismatch": 0, "missing_score": 1, "missing_reward": 0, "gate_failed": 2, "negative_reward": 0}
    assert met.value == 5  # evaluated once
    assert sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/c").collect()) == [0, 3]


def test_tables_by_key_join_without_exchange(spark, tmp_path):
    lay = lambda name, rows: joins.write_by_key(spark.createDataFrame(rows, "file string, x int"), f"laid_{name}", f"file://{tmp_path}/{name}", "file", 4)
    a, b, c = (lay(n, [(f"f{k}", k) for k in range(lo, 40)] + [(None, -1)]) for n, lo in (("a", 0), ("b", 10), ("c", 20)))
    rows = a.join(b.withColumnRenamed("x", "y").hint("merge"), "file", "left").join(c.withColumnRenamed("x", "z").hint("merge"), "file")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.z for r in rows.collect()) == list(range(20, 40))
    assert len(list((tmp_path / "a").glob("*.parquet"))) <= 4


def is_reduced(cell, eps=1e-6):
    a, b, c = cell[:3]
    x, y, z = 2 * b * c * math.cos(math.radians(cell[3])), 2 * a * c * math.cos(math.radians(cell[4])), 2 * a * b * math.cos(math.radians(cell[5]))
    a, b, c = a * a, b * b, c * c
    signs = (x > -eps and y > -eps and z > -eps) or (x < eps and y < eps and z < eps)
    return a <= b + eps and b <= c + eps and abs(x) <= b + eps and abs(y) <= a + eps and abs(z) <= a + eps and signs and x + y + z + a + b >= -eps


def cell_of(m):
    n = np.linalg.norm(m, axis=1)
    angle = lambda i, j: math.degrees(math.acos(m[i] @ m[j] / n[i] / n[j]))
    return [*n, angle(1, 2), angle(0, 2), angle(0, 1)]


def test_reduction_of_random_changes():
    """Every unimodular change of a cell has the same reduced cell, of the same volume."""
    rng = np.random.default_rng(4)
    for _ in range(25):
        base = rng.normal(size=(3, 3)) * 4 + np.eye(3) * 3
        cells, edges = [], []
        for _ in range(40):
            m = np.eye(3)
            for _ in range(rng.integers(0, 6)):
                i, j = rng.permutation(3)[:2]
                step = np.eye(3)
                step[i, j] = rng.integers(-2, 3)
                m = step @ m
            m = m[rng.permutation(3)] * rng.choice([-1, 1], size=(3, 1))
            edges.append(m @ base)
            cells.append(cell_of(m @ base))
        got, moves, good = reduction.reduced(np.array(cells))
        assert good.all() and all(is_reduced(c, 1e-3) for c in got)
        assert np.allclose(got, got[0], atol=1e-5)
        assert np.allclose(np.abs(np.linalg.det(moves)), 1)
        assert np.allclose([abs(np.linalg.det(np.array(e))) for e in edges], abs(np.linalg.det(base)))
        for c, e, mv in zip(got, edges, moves, strict=True):
            assert np.allclose(cell_of(mv.T @ e), c, atol=1e-5)


def test_reduction_of_special_cells():
    s = math.sqrt(2)
    cases = {(4, 4, 4, 90, 90, 90): (4, 4, 4, 90, 90, 90), (4 / s, 4 / s, 4 / s, 60, 60, 60): (4 / s, 4 / s, 4 / s, 60, 60, 60), (3, 3, 5, 90, 90, 120): (3, 3, 5, 90, 90, 120), (3, 3, 5, 90, 90, 60): (3, 3, 5, 90, 90, 120), (9, 2, 5, 90, 90, 90): (2, 5, 9, 90, 90, 90)}
    got, _, good = reduction.reduced(np.array(list(cases), float))
    assert good.all() and np.allclose(got, np.array(list(cases.values()), float), atol=1e-6)
    bad = np.array([[1, 1, 1, 90, 90, np.nan], [0, 1, 1, 90, 90, 90], [1, 1, 1, 10, 10, 90], [1, 1, 1, 90, 180, 90], [np.inf, 1, 1, 90, 90, 90]])
    assert not reduction.reduced(bad)[2].any() and len(reduction.reduced(np.zeros((0, 6)))[0]) == 0


def test_repaired_structures_keep_their_neighbours(spark):
    rows = [(k, {"a": 5.0, "b": 5.1 + k, "c": 31.0, "alpha": 81.0, "beta": 20.0 + k, "gamma": 85.0, "spacegroup": None, "sites": [{"el": "Na", "x": 0.1 * j, "y": 1.7 - j, "z": 0.3 * j} for j in range(4)]}) for k in range(3)]
    rows += [(8, {"a": 5.0, "b": 5.0, "c": 5.0, "alpha": 10.0, "beta": 10.0, "gamma": 90.0, "spacegroup": None, "sites": []}), (9, None)]
    df = spark.createDataFrame(rows, f"k int, s {crystal.STRUCTURE.simpleString()}")
    df = df.withColumn("cell", reduction.niggli(*[F.col(f"s.{c}") for c in neighbours.CELL])).withColumn("t", reduction.repaired(F.col("s"), F.col("cell")))
    got = df.where("t is not null")
    assert sorted(r.k for r in got.select("k").collect()) == [0, 1, 2]
    for r in got.select("t").collect():
        assert all(0 <= p[c] < 1 for p in r.t.sites for c in "xyz") and is_reduced([r.t[c] for c in neighbours.CELL], 1e-3)
    pairs = lambda c: sorted((r.k, r.site, r.other, round(r.distance, 6)) for r in neighbours.periodic_pairs(crystal.exploded_sites(got, ["k"], c), ["k"], 4.87).collect())
    assert pairs("s") == pairs("t") != []
