"""Joins of labels, scores and rewards, with defined duplicates, misses and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidelode.functions.expressions import non_empty


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: the one of highest order, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def eval_merge(labels: DataFrame, scores: DataFrame, key: str = "file", score: str = "score_e_per_atom") -> DataFrame:
    """Labels with their scores: every label row stays, blank scores count as absent, rows that only the
    scores have do not appear, and the error column is the labels' own."""
    right = scores.where(non_empty(F.col(score).cast("string"))).select(key, score)
    return labels.join(right, key, "left")


def candidate_reasons(labels: DataFrame, scores: DataFrame, rewards: DataFrame, key: str, valid: Column, score: str, reward: str, gate: str, skip_hit: bool = False, hit: str = "hit_target", need_reward: bool = True) -> DataFrame:
    """Every label row with drop_reason, the first that applies, null for candidates.

    The order is invalid_or_mismatch, missing_score, missing_reward, gate_failed, negative_reward; rows that
    only scores or rewards have are not seen. labels must be unique by key, as after last_wins.
    """
    hit_ok = F.lit(True) if skip_hit else F.coalesce(F.col(hit), F.lit(False))
    reason = F.when(~F.coalesce(valid & hit_ok, F.lit(False)), "invalid_or_mismatch").when(F.col(score).isNull(), "missing_score")
    if need_reward:
        reason = reason.when(F.col(reward).isNull(), "missing_reward").when(F.col(gate) == 1, "gate_failed").when(F.col(reward) < 0, "negative_reward")
    # both joins are on one key: the labels are shuffled once
    rows = labels.join(scores.select(key, score), key, "left").join(rewards.select(key, reward, gate), key, "left")
    return rows.withColumn("drop_reason", reason)


def reason_counts(rows: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Rows for each reason, kept ones under 'kept'."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(F.count("*").alias("n"))


#: What a label can be dropped for, in the order of the cascade.
REASONS = ("invalid_or_mismatch", "missing_score", "missing_reward", "gate_failed", "negative_reward")


def write_candidates(rows: DataFrame, path: str, reason: str = "drop_reason") -> dict[str, int]:
    """Writes the rows that no reason drops as Parquet and returns the counts of all, of kept ones and of each reason.

    The counts are taken while the rows pass on their way to the writer, so the plan is evaluated once.
    """
    seen = Observation()
    counts = [F.count("*").alias("total"), F.count_if(F.col(reason).isNull()).alias("kept"), *[F.count_if(F.col(reason) == r).alias(r) for r in REASONS]]
    rows.observe(seen, *counts).where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(path)
    return seen.get


def write_by_key(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table laid out by its key: as many buckets, each sorted. Tables of one key and number of buckets then join
    without an exchange. Each task writes one bucket, so a bucket is one file."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column | float) -> DataFrame:
    """df with a value looked up in a table that is unique by key, or the default."""
    default = default if isinstance(default, Column) else F.lit(default)
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def hull_reference(scores: DataFrame, known: DataFrame, bottom: DataFrame, group: str = "formula", energy: str = "e_per_atom") -> DataFrame:
    """Each score with its reference: the known one, else the mean of its group's lowest energies, else
    its own energy; and the excess over it."""
    both = scores.join(known.select(group, F.col("hull_energy").alias("__known")), group, "left").join(bottom.select(group, F.col("fallback").alias("__fallback")), group, "left")
    method = F.when(F.col("__known").isNotNull(), "mp_api").when(F.col("__fallback").isNotNull(), "fallback_percentile").otherwise("self")
    both = both.withColumn("hull_ref_e_per_atom", F.coalesce("__known", "__fallback", energy)).withColumn("ehull_method", method)
    return both.withColumn("ehull_proxy", F.col(energy) - F.col("hull_ref_e_per_atom")).drop("__known", "__fallback")


def existing(df: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key exists among files, and those whose key does not."""
    keys = files.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def by_phase(rows: DataFrame, keys: Sequence[str], phase: str, phases: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row a key with a column <phase>_<name> for each phase and value, by one aggregate."""
    aggs = [F.max(F.when(F.col(phase) == p, v)).alias(f"{p}_{name}") for name, v in values.items() for p in phases]
    return rows.groupBy(*keys).agg(*aggs)
