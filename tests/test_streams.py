"""Keyed state of streams: buffers, novelty, resets, initial state, restarts and retries on timers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelode.operators import reward
from tidelode.streaming import keyed

COLUMNS = "target string, seq long, e_per_atom double, min_distance double, struct_key string, reset boolean"


@pytest.fixture
def runner(spark, tmp_path):
    """Runs batches of (target, seq, energy, distance, key, reset) one after the other, each by a stream of its own."""
    session = keyed.stream_session(spark)
    uri = lambda name: f"file://{tmp_path}/{name}"

    class Runner:
        checkpoint = uri("checkpoint")

        def __call__(self, rows, **how):
            df = spark.createDataFrame(rows, COLUMNS).withColumns({"density": F.lit(3.5), "ref_density": F.lit(3.5), "mean_cn": F.lit(4.0), "max_cn": F.lit(6.0), "same": F.lit(True), "cosine": F.lit(1.0)})
            df = df.withColumns({"target_elements": F.array(F.lit("Na")), "elements": F.array(F.lit("Na"))})
            df.coalesce(1).write.mode("append").parquet(uri("in"))
            before = {r.seq for r in self.out()}
            source = session.readStream.schema(df.schema).parquet(uri("in"))
            keyed.run_available(keyed.reward_stream(source, reward.Weights(), 0.5, **how), uri("out"), self.checkpoint)
            return {r.seq: r for r in self.out() if r.seq not in before}

        def out(self):
            try:
                return spark.read.parquet(uri("out")).collect()
            except Exception:  # noqa: BLE001  nothing written yet
                return []

        def sizes(self):
            return {r.target: (r.energies, r.keys) for r in keyed.buffer_sizes(spark, self.checkpoint).collect()}

    return Runner()


def test_buffers_over_batches(runner):
    a = runner([("x", 1, 1.0, 1.0, "A", False), ("x", 2, 3.0, 0.1, "B", False), ("x", 3, 2.0, 1.0, "A", False), ("y", 4, 9.0, 1.0, "A", False), (None, 5, 7.0, 1.0, None, None)], keep_energies=6, keep_keys=2)
    # ranked within the batch, gated rows too; novelty counts rows that passed
    assert [a[k].percentile for k in (1, 2, 3, 4, 5)] == [0.0, 1.0, 0.5, 0.5, 0.5]
    assert [a[k].duplicate_flag for k in (1, 2, 3, 4, 5)] == [0, None, 1, 0, 0]
    assert a[2].gate_reason == "min_distance_below_threshold" and a[2].r_total == -1.0 and a[2].r_proxy is None
    # the first batch left all of its energies, then those that passed
    assert runner.sizes() == {"x": (5, 2), "y": (2, 1), None: (2, 1)}
    b = runner([("x", 6, 2.5, 1.0, "C", False), ("x", 7, 0.5, 1.0, "A", False), ("x", 8, None, 1.0, "D", False)], keep_energies=6, keep_keys=2)
    assert b[6].percentile == 4 / 4 and b[7].percentile == 0.0 and b[8].percentile is None  # buffer 1 3 2 1 2
    assert [b[k].duplicate_flag for k in (6, 7, 8)] == [0, 1, 0]
    assert runner.sizes()["x"] == (6, 2)
    c = runner([("x", 9, 2.5, 1.0, "A", False)], keep_energies=6, keep_keys=2)
    assert c[9].percentile == 4 / 5 and c[9].duplicate_flag == 1  # the oldest energy is gone: 3 2 1 2 2.5 0.5


def test_reset_of_one_target(runner):
    runner([("x", 1, 1.0, 1.0, "A", False), ("y", 2, 1.0, 1.0, "A", False)])
    # behind the marker a target begins anew, rows in front of it still see the old buffer
    got = runner([("x", 3, 5.0, 1.0, "A", False), ("x", 4, None, None, None, True), ("x", 5, 4.0, 1.0, "A", False), ("x", 6, 6.0, 1.0, "A", False), ("y", 7, 1.0, 1.0, "A", False)])
    assert set(got) == {3, 5, 6, 7}
    assert [got[k].duplicate_flag for k in (3, 5, 6, 7)] == [1, 0, 1, 1]
    assert [got[k].percentile for k in (3, 5, 6)] == [2.0, 0.0, 1.0]  # above the old buffer of 1.0, 1.0: clipped by its user
    assert runner.sizes() == {"x": (4, 2), "y": (3, 2)}
    runner([("x", 8, None, None, None, True), ("y", 9, None, None, None, True)])
    assert runner.sizes() == {}


def test_initial_state(runner, spark):
    initial = spark.createDataFrame([("x", 1, 1.0, "A"), ("x", 2, 2.0, None), ("x", 3, None, "B")], "target string, seq long, e_per_atom double, struct_key string")
    got = runner([("x", 1, 1.5, 1.0, "A", False), ("z", 2, 1.5, 1.0, "A", False)], initial=initial)
    assert got[1].percentile == 1.0 and got[1].duplicate_flag == 1 and got[2].duplicate_flag == 0
    assert runner.sizes() == {"x": (3, 3), "z": (2, 1)}


def test_unseeded(runner):
    runner([("x", 1, 1.0, 0.1, "A", False)], seeded=False)
    assert runner.sizes() == {}


def test_retries(spark, tmp_path):
    session = keyed.stream_session(spark)
    uri = lambda name: f"file://{tmp_path}/{name}"
    schema = "id long, at timestamp, temperature double, top_k int"

    def fails_twice(id_, attempt, temperature, top_k):
        return id_ != 9 and attempt >= 3

    def run(rows):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(uri("in"))
        made = keyed.retry_stream(session.readStream.schema(schema).parquet(uri("in")), fails_twice, 4, 60_000)
        keyed.run_available(made, uri("out"), uri("checkpoint"))
        return sorted((r.id, r.attempt, round(r.temperature, 6), r.top_k, r.due_ms // 1000 % 3600, r.ok) for r in spark.read.parquet(uri("out")).collect())

    one = (1, 1, 1.0, 40, 0, False)
    assert run([(1, "2024-01-01 00:00:00", 1.0, 40), (None, "2024-01-01 00:00:00", 1.0, 40)]) == [one]
    # a minute has passed for the second attempt, two more have not for the third; a known id does not begin again
    assert run([(2, "2024-01-01 00:01:30", 0.7, 7), (1, "2024-01-01 00:01:00", 1.0, 40)]) == [one, (1, 2, 0.8, 20, 60, False), (2, 1, 0.7, 7, 90, False)]
    # stopped and started again in between; all timers run out, one id until its last attempt
    last = run([(9, "2024-01-01 00:02:00", 0.9, 12), (3, "2024-01-03 00:00:00", 0.6, 5)])
    assert [x for x in last if x[0] == 1] == [one, (1, 2, 0.8, 20, 60, False), (1, 3, 0.64, 10, 180, True)]
    assert [x[1:] for x in last if x[0] == 9] == [(1, 0.9, 12, 120, False), (2, 0.72, 6, 180, False), (3, 0.6, 5, 300, False), (4, 0.6, 5, 540, False)]
    assert [x[1:4] for x in last if x[0] == 2] == [(1, 0.7, 7), (2, 0.6, 5), (3, 0.6, 5)]


def test_retries_share_state_by_lots(spark, tmp_path):
    """Identifiers in a row are one entry of the state, which negative and repeated ones do not confuse."""
    session = keyed.stream_session(spark)
    uri = lambda name: f"file://{tmp_path}/{name}"
    for batch, ids in enumerate(([*range(-3, 600), 5, 5], [*range(500, 1100)], [5000])):
        rows = spark.createDataFrame([(i, 0.7, 9, 86_400 * 9 if i == 5000 else 10 * (batch + 1)) for i in ids], "id long, temperature double, top_k int, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
        rows.coalesce(1).write.mode("append").parquet(uri("in"))
        made = keyed.retry_stream(session.readStream.schema(rows.schema).parquet(uri("in")), lambda id_, attempt, t, k: attempt > abs(id_) % 3, 3, 60_000)
        keyed.run_available(made, uri("out"), uri("checkpoint"))
    got = sorted((r.id, r.attempt, r.due_ms, r.ok) for r in spark.read.parquet(uri("out")).collect() if r.id < 5000)
    at = lambda i: 10_000 if i < 600 else 20_000
    assert got == [(i, a, at(i) + (0, 60_000, 180_000)[a - 1], a == abs(i) % 3 + 1) for i in range(-3, 1100) for a in range(1, abs(i) % 3 + 2)]


def test_a_lot_is_written_once_a_batch():
    class Fake:
        value, writes, timers = None, 0, ()

        def getValueState(self, name, schema): return self  # noqa: E704
        def exists(self): return self.value is not None  # noqa: E704
        def get(self): return self.value  # noqa: E704
        def registerTimer(self, at): self.timers = (*self.timers, at)  # noqa: E704
        def deleteTimer(self, at): self.timers = tuple(x for x in self.timers if x != at)  # noqa: E704
        def getCurrentWatermarkInMs(self): return 0  # noqa: E704
        def update(self, value): self.value, self.writes = value, self.writes + 1  # noqa: E704

    fake = Fake()
    queue = keyed.RetryQueue(lambda *_: False, 3, 1000)
    queue.init(fake)
    rows = pd.DataFrame({"id": range(600), "at_ms": range(600, 0, -1), "temperature": 0.7, "top_k": 9})
    (made,) = queue.handleInputRows((0,), iter([rows, rows]), fake)
    assert len(made) == 600 and fake.writes == 1 and fake.timers == (1001,)
