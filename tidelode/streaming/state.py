"""State that is kept across batches: score and novelty buffers, and the log of a run.

Each target has the newest energies (for percentile ranks) and structure keys (for novelty) of rows that
passed the gate. `RewardState` keeps them as tables of versions in a shared folder; `scored_stream` feeds it
from a file stream, one micro-batch after another, so a batch sees what all earlier ones left. A batch that
runs again (after a failure) finds its own version written and writes it anew from the version before, so
results do not depend on how often it ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.operators import ranking, reward

#: Newest rows of a target that are kept.
KEEP_ENERGIES, KEEP_KEYS = 50_000, 2_000


class RewardState:
    """The buffers of all targets, by version; version n is what batch n - 1 left."""

    def __init__(self, spark: SparkSession, root: str, keep_energies: int = KEEP_ENERGIES, keep_keys: int = KEEP_KEYS):
        self.spark, self.root = spark, root.rstrip("/")
        self.keep = {"energies": keep_energies, "keys": keep_keys}

    _SCHEMA = {"energies": "target string, seq bigint, e_per_atom double", "keys": "target string, seq bigint, struct_key string"}

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p))

    def read(self, name: str, version: int) -> DataFrame:
        """A buffer as of a version; empty before the first."""
        path = f"{self.root}/{name}/version={version}"
        if version and self._exists(f"{path}/_SUCCESS"):
            return self.spark.read.schema(self._SCHEMA[name]).parquet(path)
        return self.spark.createDataFrame([], self._SCHEMA[name])

    def write(self, name: str, version: int, rows: DataFrame) -> None:
        """Trims each target to its newest rows, numbers them anew, and writes them as a version."""
        kept = ranking.newest(rows, ["target"], "seq", self.keep[name])
        kept.select(*rows.columns).write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")

    def reset(self) -> None:
        """Forgets all buffers, as between phases."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def process(state: RewardState, version: int, batch: DataFrame, weights: reward.Weights, window: int, least_distance: float, compat: bool = False) -> DataFrame:
    """Rewards of one batch against the state's version, and the next version.

    With compat the first batch leaves all its energies in the buffer and then those that passed again, as
    the original program does; otherwise only those that passed, once.
    """
    energies, keys = state.read("energies", version), state.read("keys", version)
    first = energies.isEmpty()
    rows = reward.composite(batch, weights, least_distance, window, keys.withColumnRenamed("seq", "hseq"), None if first else energies.select("target", "e_per_atom"))
    passed = rows.where("gate_failed = 0")
    # new rows come behind all old ones of their target
    top = F.coalesce(F.max("seq"), F.lit(-1))
    after = lambda old, new, col: old.unionByName(new.join(F.broadcast(old.groupBy("target").agg(top.alias("__top"))), "target", "left").select("target", (F.coalesce("__top", F.lit(-1)) + 1 + F.col("seq")).alias("seq"), col))
    base = energies
    if first and compat:
        base = batch.select("target", F.col("seq").cast("bigint").alias("seq"), "e_per_atom")
    state.write("energies", version + 1, after(base, passed.select("target", "seq", "e_per_atom"), "e_per_atom"))
    state.write("keys", version + 1, after(keys, passed.select("target", "seq", "struct_key"), "struct_key"))
    return rows


def scored_stream(spark: SparkSession, source: DataFrame, state: RewardState, out: str, checkpoint: str, weights: reward.Weights | None = None, window: int = 2000, least_distance: float = 0.5) -> None:
    """Rewards of all files that a stream has now, batch by batch, written to out by version."""

    def one(batch: DataFrame, epoch: int) -> None:
        rows = process(state, epoch, batch, weights or reward.Weights(), window, least_distance)
        rows.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def novelty_stream(spark: SparkSession, source: DataFrame, item: str, order: str, width: int, root: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whether rows of a file stream repeat an item of the last `width` rows, with history across batches.

    Each batch is ordered by itself; its last rows are the history of the next one.
    """
    target = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))
    schema = f"target string, hseq bigint, {item} string"

    def one(batch: DataFrame, epoch: int) -> None:
        old = spark.read.schema(schema).parquet(f"{root}/history/batch={epoch - 1}") if epoch else spark.createDataFrame([], schema)
        rows = batch.withColumn("target", target)
        flagged = ranking.duplicate_in_window(rows, ["target"], item, [order], width, old)
        flagged.drop("target").write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")
        shift = F.coalesce(F.lit(old.agg(F.max("hseq")).head()[0]), F.lit(-1)) + 1
        news = old.unionByName(rows.select("target", (shift + F.col(order)).cast("bigint").alias("hseq"), item))
        ranking.newest(news, ["target"], "hseq", width).select("target", "hseq", item).write.mode("overwrite").parquet(f"{root}/history/batch={epoch}")

    source.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")


def appended_log(source: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream of records to a folder of JSON lines."""
    source.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false").trigger(availableNow=True).start().awaitTermination()


def daily_counts(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Counts of event types by day, with a watermark of a day; parquet's local timestamps are cast first."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    counts = timed.groupBy(F.window("at", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retried(todo: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], most: int, checkpointed: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Runs rows until all are done or `most` attempts are made: (done, left over).

    attempt gives the rows of a batch that succeeded; checkpointed writes a table and reads it again.
    """
    done, left = None, todo
    for k in range(most):
        made = checkpointed(attempt(left, k), f"attempt-{k}")
        done = made if done is None else done.unionByName(made)
        left = checkpointed(left.join(made, key, "left_anti"), f"left-{k}")
        if left.isEmpty():
            break
    return done, left
