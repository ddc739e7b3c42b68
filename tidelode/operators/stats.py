"""Aggregations: rates, moments, percentiles, distributions and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelode.functions.expressions import finite, non_empty
from tidelode.operators.ranking import percentiles


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def scored_counts(df: DataFrame, score: str) -> DataFrame:
    """Rows, and rows with a non-blank score."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(non_empty(score)).alias("n_scored"))


def hit_rates(valid: Column, hit: Column) -> list[Column]:
    """Counts of rows, valid and hit ones, and their rates."""
    total = F.count("*")
    return [total.alias("total"), F.count_if(valid).alias("valid"), F.count_if(hit).alias("hits"), rate(F.count_if(valid), total).alias("validity_rate"), rate(F.count_if(hit), total).alias("hit_rate")]


def described(df: DataFrame, keys: Sequence[str], value: str, moments: Sequence[Column], shares: dict[str, float]) -> DataFrame:
    """Aggregates of a value within keys, with exact percentiles beside them, by one evaluation of df."""
    return percentiles(df, keys, value, shares, moments)


def energy_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median and sample standard deviation, the last 0 for one row."""
    moments = [exact_mean(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std")]
    return described(df, keys, value, moments, {"median": 0.5}).select(*keys, "mean", "median", "std")


def component_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, 5th, 50th and 95th percentile of finite values, 0 without any."""
    rows = df.select(*keys, F.when(finite(value), F.col(value)).alias(value))
    out = described(rows, keys, value, [exact_mean(value).alias("mean"), F.stddev_pop(value).alias("std")], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std", "p05", "p50", "p95")])


def stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Several numeric columns as rows of name and value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*")


def exact_mean(value: str) -> Column:
    """The mean by a sum of decimals of 12 places, which does not depend on the order of rows.

    Sums of doubles do: their error grows with the table and turns means that end in a 5. Values beyond 10**20, NaN
    and infinity are no such decimals; with any of them the mean is that of doubles.
    """
    x = F.when(F.abs(value) < 1e20, F.col(value).cast("decimal(32,12)"))
    exact = F.when(F.count(x) == F.count(value), F.try_divide(F.try_sum(x), F.count(x)).cast("double"))
    return F.coalesce(exact, F.avg(value))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: mean, median, population deviation, minimum, maximum."""
    moments = [exact_mean("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")]
    return described(stacked(df, columns), ["name"], "value", moments, {"median": 0.5}).select("name", "mean", "median", "std", "min", "max")


def gap_stats(df: DataFrame, value: str) -> DataFrame:
    """The distribution of a gap in one row: count, moments, range, and five percentiles."""
    x = F.col(value)
    moments = [F.count("*").alias("n"), F.avg(x).alias("gap_mean"), F.stddev_pop(x).alias("gap_std"), F.min(x).cast("double").alias("gap_min"), F.max(x).cast("double").alias("gap_max")]
    return described(df, [], value, moments, {"gap_median": 0.5, **{f"gap_p{p}": p / 100 for p in (10, 25, 75, 90)}})


def counts_per(df: DataFrame, key: str) -> DataFrame:
    """Rows a key, then mean, least, most and population deviation of these counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.stddev_pop("n").alias("std"))


def most_common(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The k commonest values; of equal counts the one met first. Planned as a top-k, not a full sort."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def fractions(df: DataFrame, key: str) -> DataFrame:
    """Rows a key and their share of all. The total is a one-row join side, not a global window."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return counts.join(F.broadcast(total)).select(key, "n", rate(F.col("n"), F.col("__total")).alias("fraction"))


def diversity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys over rows; 1 for at most one row."""
    distinct = F.count_distinct(F.struct(*keys))
    return df.agg(F.count("*").alias("n"), distinct.alias("distinct_keys"), F.when(F.count("*") <= 1, 1.0).otherwise(rate(distinct, F.count("*"))).alias("diversity_ratio"))


def merge_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two tables of counts added up."""
    return a.unionByName(b).groupBy(key).agg(F.sum("n").alias("n"))


def weighted_mean(value: str, weight: str) -> Column:
    return rate(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def latency_split(value: str, ok: Column) -> list[Column]:
    """Mean over all rows and over successes."""
    return [F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_all"), F.coalesce(F.avg(F.when(ok, F.col(value))), F.lit(0.0)).alias("mean_success")]


def count_windows(df: DataFrame, step: str, every: int, values: Sequence[str]) -> DataFrame:
    """Means of each `every` steps, numbered from 1."""
    return df.groupBy(F.ceil(F.col(step) / every).alias("window")).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def best_step(value: str, step: str) -> list[Column]:
    """The least value and the first step that has it."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s")))
    return [best.v.alias("best_value"), best.s.alias("best_step")]


def timing_rollup(log: DataFrame, order: str = "seq") -> DataFrame:
    """Durations of phases that have a start and an end, by the last of each."""
    at = lambda s: F.max_by("timestamp", F.when(F.col("status") == s, F.col(order)))
    spans = log.groupBy("phase").agg(at("start").alias("started"), at("end").alias("ended"))
    return spans.where("started is not null and ended is not null").select("phase", (F.col("ended") - F.col("started")).alias("seconds"))


def clamped_std(value: str, least: float = 1e-8) -> Column:
    """The sample deviation, held above a least so that it can divide."""
    return F.greatest(F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.lit(least))


def histogram(df: DataFrame, value: str, bins: int, shares: tuple[float, float] | None = None, density: bool = False) -> DataFrame:
    """Rows of each of equal bins over the range of finite values, or between two percentiles of it, the last
    bin closed on both sides; values outside are dropped. Empty bins have 0; without finite values there is no
    row. density adds a column of that name: the share of rows over the width, null for a range of one value."""
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x")).where(finite("x"))
    range_ = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")) if shares is None else percentiles(rows, [], "x", {"lo": shares[0], "hi": shares[1]})
    inside = rows.join(F.broadcast(range_)).where("x >= lo and x <= hi")
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = inside.groupBy(bucket.cast("int").alias("b")).agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    # a row a bin: bins are few, whatever the table's size
    all_ = counts.agg(F.collect_list(F.struct("b", "c")).alias("cs"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum("c").alias("total")).where("lo is not null")
    out = all_.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.map_from_entries("cs").alias("cs"), "lo", "hi", "total")
    width = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce(F.try_element_at("cs", "bin"), F.lit(0)).alias("n")
    more = [F.try_divide(n, F.col("total") * width).alias("density")] if density else []
    return out.select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("left_edge"), n, *more)


def extension_counts(paths: DataFrame) -> DataFrame:
    """Files of each extension, from a table of paths."""
    return paths.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")).agg(F.count("*").alias("n"))
