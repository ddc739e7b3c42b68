"""Samples, splits, allocations and preference pairs, alike in every run.

Random choices follow the md5 of a seed and the row's key, so they are independent of partitioning and can
be repeated by any engine. Exact counts come from placing rows in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelode.functions.expressions import draw, hash_order
from tidelode.operators.ranking import matched, placed, running

#: Rows up to which a sample is a top-k, which ends in one task.
TOP_K = 100_000


class AllocationError(ValueError):
    """An allocation that cannot be met; code tells no data (1), too few rows (2) or a wrong total (3)."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def exact_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by hash: a top-k, which every task cuts to n rows first, or beyond TOP_K rows a range sort."""
    if n > TOP_K:
        return placed(df, [], [hash_order(seed, key), key]).where(F.col("place") <= n).select(*df.columns)
    return df.withColumn("__h", hash_order(seed, key)).orderBy("__h", key).limit(n).drop("__h")


def split(df: DataFrame, keys: Sequence[str], share: float, seed: int, key: str, name: str = "is_val") -> DataFrame:
    """Marks the first int(n * share) rows within keys, in hash order, for validation."""
    rows = placed(df, keys, [hash_order(seed, key), key])
    return rows.withColumn(name, F.col("place") <= F.floor(F.col("group_size") * share)).drop("place", "group_size")


def allocate(counts: DataFrame, total: int, target: str = "target", n: str = "n", order: str | None = None) -> DataFrame:
    """Largest-remainder shares of a total over targets with n rows each: target, n, alloc.

    counts has a row a target, so the window over all of it is small. Ties go by order.
    """
    order = order or target
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw = F.lit(total) * F.col(n) / F.sum(n).over(all_)
    rows = counts.withColumn("__raw", raw).withColumn("__floor", F.floor("__raw"))
    rows = rows.withColumn("__rest", F.lit(total) - F.sum("__floor").over(all_))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("__raw") - F.col("__floor")), F.col(order)))
    return rows.withColumn("alloc", F.col("__floor") + F.when(rank <= F.col("__rest"), 1).otherwise(0)).drop("__raw", "__floor", "__rest")


def checked_allocation(counts: DataFrame, total: int, target: str = "target", n: str = "n") -> DataFrame:
    """allocate, with the errors of a merge that cannot reach its total."""
    have = counts.agg(F.coalesce(F.sum(n), F.lit(0))).head()[0]
    if not have:
        raise AllocationError(1, "no rows to allocate from")
    if have < total:
        raise AllocationError(2, f"{total} rows asked for, {have} there")
    shares = allocate(counts, total, target, n)
    got, over = shares.agg(F.sum("alloc"), F.count_if(F.col("alloc") > F.col(n))).head()
    if got != total or over:
        raise AllocationError(3, f"allocated {got} of {total}")
    return shares


def take_allocated(df: DataFrame, shares: DataFrame, target: str, seed: int, key: str) -> DataFrame:
    """Of each target its allocated number of rows, in hash order; null is a target. shares has a row a target."""
    rows = placed(df, [target], [hash_order(seed, key), key])
    return matched(rows, F.broadcast(shares.select(target, "alloc")), [target]).where("place <= alloc").drop("place", "group_size", "alloc")


def preference_pairs(df: DataFrame, prompt: str, key: str, reward: str, gap: float, cap: int, seed: int, most_tokens: int | None = None, tokens: str = "n_tokens", tries: int = 20) -> DataFrame:
    """Pairs (chosen, rejected) of a prompt's top and bottom pool with a reward gap of at least `gap`, at
    most `cap` a prompt, by hash order. df has in_top and in_bottom; keep texts out of it and join them
    to the result. Rows of null reward are in no pair; a null prompt is a prompt.

    Pools are never crossed whole. The rejected rows that go with a chosen one are the last ones of their pool
    in falling reward, so counting them numbers all pairs of a prompt that meet the gap, in the order of both
    places. Of these numbers tries * cap are drawn (or all are taken, if they are no more) and only the drawn
    pairs are made. A prompt with that many pairs gets its cap, however rare they are among all.
    """
    pools = df.where(F.col(reward).isNotNull())
    cols = [prompt, F.col(key), F.col(reward).cast("double").alias(reward), *([F.col(tokens)] if most_tokens else [])]

    def pool(flag: str, side: str) -> DataFrame:
        rows = pools.where(flag).select(*cols)
        if most_tokens:
            rows = rows.where(F.col(tokens) <= most_tokens)
        rows = placed(rows, [prompt], [-F.col(reward), key], f"{side}_place", f"{side}_size")
        return rows.withColumnsRenamed({key: f"{side}_{key}", reward: f"{side}_reward", tokens: f"{side}_tokens"})

    top, bottom = pool("in_top", "chosen"), pool("in_bottom", "rejected")
    # rejected rows at or below each chosen reward less the gap; a little more, as the gap itself is tested below
    bound = F.col("chosen_reward") - gap + F.greatest(F.abs("chosen_reward"), F.lit(1.0)) * 1e-9
    both = bottom.select(prompt, F.col("rejected_reward").alias("__v"), F.lit(1).alias("__below")).unionByName(top.withColumnsRenamed({f"chosen_{key}": "__key"}).withColumn("__v", bound).withColumn("__below", F.lit(0)), allowMissingColumns=True)
    counted = running(placed(both, [prompt], ["__v", F.lit(1) - F.col("__below")]), [prompt], "__below").where("__below = 0 and __running > 0")
    chosen = counted.select(prompt, F.col("__key").alias(f"chosen_{key}"), "chosen_reward", *(["chosen_tokens"] if most_tokens else []), F.col("__running").alias("__fits"), F.col("chosen_place").alias("place"), F.col("chosen_size").alias("group_size"))
    chosen = running(chosen, [prompt], "__fits").withColumn("__from", F.col("__running") - F.col("__fits"))
    limit = tries * cap
    sizes = chosen.groupBy(prompt).agg(F.max("__running").alias("__pairs"))
    number = F.when(F.col("__pairs") <= limit, F.col("i")).otherwise(draw(seed, F.col("__pairs"), prompt, "i", digits=15))
    draws = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("__pairs", F.lit(limit)) - 1))).select(prompt, "__pairs", number.alias("__number")).distinct()
    # numbers meet the chosen rows whose pairs hold them by bins, of which a prompt has `limit` at most
    width = F.ceil(F.col("__pairs") / limit)
    bins = matched(chosen, sizes, [prompt]).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__from") / width), F.floor((F.col("__running") - 1) / width)))).drop("__pairs", "place", "group_size")
    drawn = matched(bins, draws.withColumn("__bin", F.floor(F.col("__number") / width)).drop("__pairs"), [prompt, "__bin"]).where("__number >= __from and __number < __running")
    ends = bottom.groupBy(prompt).agg(F.max("rejected_size").alias("__last"))
    drawn = matched(drawn, ends, [prompt]).withColumn("rejected_place", F.col("__last") - F.col("__fits") + 1 + F.col("__number") - F.col("__from"))
    pairs = matched(drawn, bottom, [prompt, "rejected_place"])
    pairs = pairs.where((F.col(f"chosen_{key}") != F.col(f"rejected_{key}")) & (F.col("chosen_reward") - F.col("rejected_reward") >= gap))
    order: list[Column] = [hash_order(seed, f"chosen_{key}", f"rejected_{key}"), F.col(f"chosen_{key}"), F.col(f"rejected_{key}")]
    rank = F.row_number().over(Window.partitionBy(prompt).orderBy(*order))
    out = pairs.withColumn("__rank", rank).where(F.col("__rank") <= cap)
    return out.select(prompt, *[f"{side}_{c}" for side in ("chosen", "rejected") for c in (key, "reward", *(["tokens"] if most_tokens else []))])


def epochs(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """df once for each epoch, with a number that orders each epoch anew."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("shuffle_key", hash_order(seed, "epoch", key))


#: Rounds of the permutation; steps after which a number has left the part of its range that is no row, all but never.
ROUNDS, WALKS = 4, 256


def _mixed(value: Column, keys: Column, half: Column) -> Column:
    """One pass of a Feistel network over numbers of 2 * half bits: a permutation of them for each list of keys."""
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), half) - 1

    def round_(v: Column, key: Column) -> Column:
        right = v.bitwiseAND(side)
        noise = F.shiftright((right * right + key) % (1 << 31) * 1103515245, 15).bitwiseAND(side)
        return F.call_function("shiftleft", right, half) + F.call_function("shiftright", v, half).bitwiseXOR(noise)

    return F.aggregate(keys, value, round_)


def row_at(epoch: Column, position: Column, n: Column, seed: int) -> Column:
    """The number, from 0, of the row that an epoch reads at a position from 0: a keyed permutation of n numbers.

    A Feistel network permutes the numbers below the next power of 4; one that falls outside of n is permuted again
    until it does not (about 4 times at most on average), which permutes those below n. Nothing is stored: an epoch's
    order follows from the seed, so a run goes on from any step without having read what lies before it. n may be up
    to 2**60.
    """
    half = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")) / 2)).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), epoch, r)), 1, 7), 16, 10).cast("bigint"))
    first = _mixed(position.cast("bigint"), keys, half)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(_mixed(v, keys, half)))
    return F.when(position < n, F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the permutation has not come back"))))


def epoch_rows(numbered: DataFrame, number: str, n: int, seed: int, first: int, count: int) -> DataFrame:
    """The rows that steps first to first + count - 1 of training read, with step, epoch and position.

    numbered has n rows with a number from 0 each. Only the steps asked for are made, and they meet their rows by
    number; the table is neither copied nor sorted for an epoch.
    """
    steps = numbered.sparkSession.range(first, first + count if n else first).withColumnRenamed("id", "step")
    steps = steps.withColumns({"epoch": F.floor(F.col("step") / max(n, 1)), "position": F.col("step") % max(n, 1)})
    return steps.withColumn(number, row_at(F.col("epoch"), F.col("position"), F.lit(n), seed)).join(numbered, number)
