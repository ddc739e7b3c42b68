"""Connected components of a link table, wholly distributed, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelode.llm.workspace import Workspace, release

#: Rounds after which a graph that still changes is reported as an error; stars need O(log n) rounds.
MOST_ROUNDS = 60


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).head())


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for each node of links(a, b): the smallest node that it reaches.

    Large-star and small-star rounds alternate until no edge changes. Each keeps one minimum a node,
    aggregated before the shuffle, so a hub of any degree is split over tasks; the joins that hand the
    minimum back are plain sort-merge joins, which adaptive execution splits by skew. Nodes without links
    are not returned; nulls and links of a node with itself are ignored.
    """
    edges = work.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    marks, stale = _marks(edges), None
    for k in range(MOST_ROUNDS):
        if not marks[0]:
            break
        # large star: each node hands its larger neighbours to the smallest node around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        after = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = work.write(after, f"{name}-{k + 1}")
        if stale:
            work.drop(stale)
        stale, before = f"{name}-{k}", marks
        edges, marks = after, _marks(after)
        release(work.spark)
        if marks == before:
            break
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
