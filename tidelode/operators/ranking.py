"""Ranks, percentile ranks, pools and top-k.

A window without a partition key, or over few keys, sorts a whole group in one task. `placed` numbers rows
in an order without that: rows are sorted by range over all tasks, counted a part and group, and each row's
number is its place in its part plus the rows of its group in the parts before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelode.scratch import BROADCAST_BYTES, Workspace, sized


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], place: str = "place", size: str = "group_size") -> DataFrame:
    """df with each row's number from 1 within its keys, and the rows of its keys, in two sorted passes.

    The order rises (give the negative of a falling key) and should be total; rows that it leaves equal are
    numbered in any order.
    """
    work = Workspace(df.sparkSession, "placed")
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    named = {f"__o{k}": c for k, c in enumerate(by)}
    sort = list(named)
    rows = work.write(df.withColumns(named).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "sorted")
    ks = [f"__o{k}" for k in range(len(keys))]
    parts = work.write(rows.groupBy(*ks, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first")), "parts")
    # one row a part and key: the window sorts as many rows as there are tasks
    w = Window.partitionBy(*ks).orderBy("__part")
    parts = parts.select(*[F.col(k).alias(f"{k}k") for k in ks], F.col("__part").alias("__p"), "__first", (F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*ks)).alias(size))
    on = F.col("__part") == F.col("__p")
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}k"))
    out = rows.join(parts, on).withColumn(place, F.col("__row") - F.col("__first") + F.col("__before") + 1)
    return out.select(*df.columns, place, size)


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined to right on keys of which a null equals a null; the keys come once, from left."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.lit(True))
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def cumulated(df: DataFrame, keys: Sequence[str], value: str, work: Workspace) -> DataFrame:
    """One row for each distinct value within keys: upto, the rows of values up to it; n, its own; total.

    Equal values are counted before the shuffle and are one row after it, so a value that a third of the rows have
    is no larger than others. Distinct values are sorted by range, summed by part, and numbered inside of parts.
    Null values are left out; null keys are a group; NaN is above all numbers.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rows = work.write(counts.repartitionByRange(*[F.col(c) for c in (*keys, value)]).withColumn("__part", F.spark_partition_id()), "counts")
    parts = rows.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))
    w = Window.partitionBy(*keys)
    # one row a part and key
    parts = parts.select(*keys, "__part", (F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("total"))
    own = F.sum("n").over(Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    out = matched(rows.withColumn("__own", own), parts, [*keys, "__part"])
    return out.select(*keys, value, "n", (F.col("__own") + F.col("__before")).alias("upto"), "total")


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "pr") -> DataFrame:
    """(values below) / (n - 1) within keys, 0.5 for a group of one.

    A null value has a null rank and does not count for others; NaN is above all numbers; null keys are a group.
    """
    work = Workspace(df.sparkSession, "percentile-rank")
    below = cumulated(df, keys, value, work).select(*keys, value, F.when(F.col("total") > 1, (F.col("upto") - F.col("n")) / (F.col("total") - 1)).otherwise(0.5).alias("__rank"))
    ranks = work.write(below, "ranks")
    # few distinct values are broadcast; of many, a frequent one's rows are split by adaptive execution
    return matched(df, sized(ranks, 16 + 24 * len(keys)), [*keys, value], "left").withColumn(name, F.col("__rank")).select(*df.columns, name)


#: Values of one key that a sorted array holds; larger buffers are ranked by a sort of buffer and batch.
MOST_BUFFER = 100_000


def _below(values: Column, x: Column, most: int) -> Column:
    """How many values of a sorted array are below x, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        less = (s.lo < s.hi) & (F.get(values, mid) < x)
        return F.struct(F.when(less, mid + 1).otherwise(s.lo).alias("lo"), F.when(less | (s.lo >= s.hi), s.hi).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(max(1, most).bit_length())), start, halve, lambda s: s.lo)


def percentile_rank_in(df: DataFrame, buffer: DataFrame, keys: Sequence[str], value: str, name: str = "pr") -> DataFrame:
    """(buffer values below) / (buffer size - 1) within keys, 0.5 for a buffer of one, null without a buffer.

    The batch itself does not count; the rank may exceed 1 and is clipped by its user. Null values have a null
    rank and do not count in a buffer; null keys are a group. A buffer of a key is bounded by what its state keeps, so
    it is one sorted array, broadcast if all arrays together are small: the batch is then neither shuffled nor sorted.
    """
    work = Workspace(df.sparkSession, "rank-in")
    buffer = work.write(buffer.where(F.col(value).isNotNull()).select(*keys, value), "buffer")
    most, total = buffer.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    if most > MOST_BUFFER:
        return _rank_in_any(df, buffer, keys, value, name)
    arrays = buffer.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__values"))
    out = matched(df, F.broadcast(arrays) if total * 16 <= BROADCAST_BYTES else arrays, keys, "left")
    n = F.size("__values")
    rank = F.when(F.col(value).isNull() | F.col("__values").isNull(), None).when(n == 1, 0.5).otherwise(_below(F.col("__values"), F.col(value), most) / (n - 1))
    return out.withColumn(name, rank).select(*df.columns, name)


def _rank_in_any(df: DataFrame, buffer: DataFrame, keys: Sequence[str], value: str, name: str = "pr") -> DataFrame:
    """Ranks against buffers of any size: batch and buffer are sorted together."""
    both = buffer.select(*keys, value).withColumn("__own", F.lit(0)).unionByName(df.withColumn("__own", F.lit(1)), allowMissingColumns=True)
    # equal values: the batch's rows in front of the buffer's, so that places count smaller ones only
    rows = placed(both, keys, [value, F.lit(1) - F.col("__own")])
    counted = running(rows.withColumn("__is", 1 - F.col("__own")), keys, "__is")
    size = buffer.groupBy(*keys).agg(F.count("*").alias("__size"))
    out = matched(counted.where("__own = 1"), size, keys, "left")
    rank = F.when(F.col(value).isNull(), None).when(F.col("__size") == 1, 0.5).when(F.col("__size") > 1, F.col("__running") / (F.col("__size") - 1))
    return out.withColumn(name, rank).select(*df.columns, name)


def running(rows: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Of placed rows the sum of a column up to each, as __running.

    Places are cut into ranges, whose sums precede their rows. A key of n rows has about sqrt(n) ranges of as
    many rows, so neither the window over ranges nor that inside of one grows faster.
    """
    step = F.greatest(F.lit(4096), F.ceil(F.sqrt("group_size")))
    cut = rows.withColumn("__range", F.floor(F.col("place") / step))
    sums = cut.groupBy(*keys, "__range").agg(F.sum(flag).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    own = F.sum(flag).over(Window.partitionBy(*keys, "__range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return matched(cut.withColumn("__within", own), before, [*keys, "__range"]).withColumn("__running", F.col("__within") + F.col("__before"))


def duplicate_in_window(df: DataFrame, keys: Sequence[str], item: str, order: Sequence[Column | str], width: int, history: DataFrame | None = None) -> DataFrame:
    """Whether a row's item occurred among the last `width` rows before it; history rows come first.

    history holds keys, item and a column hseq that orders it, oldest first.
    """
    rows = df.withColumn("__old", F.lit(0)).withColumn("__h", F.lit(None).cast("bigint"))
    if history is not None:
        old = history.select(*keys, item, F.lit(1).alias("__old"), F.col("hseq").cast("bigint").alias("__h"))
        rows = rows.unionByName(old, allowMissingColumns=True)
    rows = placed(rows, keys, [F.lit(1) - F.col("__old"), "__h", *order])
    # an item's rows are few next to its key's: the window is by both
    gap = F.col("place") - F.lag("place").over(Window.partitionBy(*keys, item).orderBy("place"))
    return rows.withColumn("duplicate_flag", F.coalesce((gap <= width).cast("int"), F.lit(0))).where("__old = 0").select(*df.columns, "duplicate_flag")


def bottom_mean(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str = "fallback") -> DataFrame:
    """The mean of each group's max(1, int(n * share)) least values, null values left out."""
    rows = cumulated(df, keys, value, Workspace(df.sparkSession, "bottom-mean"))
    k = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    taken = F.greatest(F.lit(0), F.least("n", k - F.col("upto") + F.col("n")))
    return rows.withColumn("__taken", taken).where("__taken > 0").groupBy(*keys).agg((F.sum(F.col(value) * F.col("__taken")) / F.sum("__taken")).alias(name))


def pools(df: DataFrame, keys: Sequence[str], reward: str, tie: Sequence[str], top: float, bottom: float, strategy: str = "trajectory") -> DataFrame:
    """Rows with in_top and in_bottom: the first and last max(1, int(n * share)) by falling reward within
    keys; strategy 'all' puts every row in both."""
    if strategy == "all":
        return df.withColumns({"in_top": F.lit(True), "in_bottom": F.lit(True)})
    rows = placed(df, keys, [-F.col(reward), *tie])
    k = lambda share: F.greatest(F.lit(1), F.floor(F.col("group_size") * share))
    return rows.withColumns({"in_top": F.col("place") <= k(top), "in_bottom": F.col("place") > F.col("group_size") - k(bottom)}).drop("place", "group_size")


def _at(index: Column, value: str) -> Column:
    """Of cumulated rows the value at an index from 0 of the sorted group."""
    return F.max(F.when((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index), F.col(value)))


def nearest_index(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """P10 and P90 as sorted[int(n * p)] for more than 10 rows, else least and most; best and worst. Nulls are left out."""
    rows = cumulated(df, keys, value, Workspace(df.sparkSession, "nearest-index"))
    many = F.max("total") > 10
    spot = lambda p: _at(F.floor(F.col("total") * p), value)
    return rows.groupBy(*keys).agg(F.when(many, spot(0.1)).otherwise(F.min(value)).alias("p10"), F.when(many, spot(0.9)).otherwise(F.max(value)).alias("p90"), F.min(value).alias("best"), F.max(value).alias("worst"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], moments: Sequence[Column] = ()) -> DataFrame:
    """Exact percentiles by linear interpolation within keys, one column each, behind other aggregates.

    Built-in exact percentiles hold a group's distinct values in one task; here they come from running counts of
    distinct values. df is evaluated once, for its keys and value alone; moments see its null values.
    """
    work = Workspace(df.sparkSession, "percentiles")
    rows = work.write(df.select(*keys, value), "values") if moments else df
    spot = lambda p: (F.col("total") - 1) * p
    aggs = []
    for name, p in shares.items():
        low, high = (_at(i, value).cast("double") for i in (F.floor(spot(p)), F.ceil(spot(p))))
        aggs.append((low + (high - low) * F.max(spot(p) - F.floor(spot(p)))).alias(name))
    found = cumulated(rows, keys, value, work).groupBy(*keys).agg(*aggs)
    if not moments:
        return found
    summed = rows.groupBy(*keys).agg(*moments)
    return matched(summed, found, keys, "left") if keys else summed.join(F.broadcast(found))


def ecdf(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Each row's i / n in the order of values; rows of equal value have different points."""
    return placed(df, keys, [value, *tie]).withColumn("cdf", F.col("place") / F.col("group_size")).drop("place", "group_size")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank. Spark cuts groups to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def newest(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return top_n(df, keys, [F.desc(order)], n, "age")


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of highest order of each key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
