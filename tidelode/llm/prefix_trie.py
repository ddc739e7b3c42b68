"""A trie of the prefixes of conversations, summed from its leaves by messages to parents.

A node is a distinct sequence of first turns. Its key is its depth and the exclusive or of 128-bit hashes of its
turns, each hashed with its place, so keys of all prefixes are running sums that a window or a join of window parts
yields, however long a conversation is. Nodes are counted by key, pre-aggregated before the shuffle, and meet their
parents by the key without the last turn.

Along a path whose nodes have the same members nothing branches or ends. Such a run of nodes, known by its smallest
member and number of members, is one vertex of the tree that is peeled: each vertex holds a counter of the children
that it still waits for, and totals. Vertices whose counter is 0 are complete and send their totals to their parents,
added up by parent before the shuffle; parents subtract and add, and the next round peels those that reach 0, until
the root has finished. Rounds are as many as runs lie on one path, not as turns do; each round is a written table,
which holds only what still waits and what has just finished. Nodes inside of a run then take the run's totals less
what lies above them in it.

Identifiers of the conversations that end at a node are numbered in their order across tasks and joined in pieces of
PIECE; the digest of several pieces runs over them one after the other, one piece in memory at a time.

Defined cases: rows without conv_id take no part; a null turn comes first; rows of one turn are ordered by the hashes
of role and text; null roles and texts are empty, and an empty turn is a turn; very long texts are read once, by
their hash and length, and never shuffled; an empty table gives no rows, not even a root. Other columns are not
read. Sequences of equal 128-bit keys count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.workspace import Workspace
from tidelode.operators.ranking import placed

#: Conversations of one block share the first turns of the block's first, at most SHARED - 1 of them.
BLOCK, SHARED = 100, 6
#: Rows of one key that a window sums at once; identifiers in a piece of text.
RUN, PIECE = 4096, 1024

_NODE = ["depth", "k1", "k2"]


def hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, chars): turns without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), "turn", F.xxhash64(F.lit(11), role, text).alias("h1"), F.xxhash64(F.lit(12), role, text).alias("h2"), F.length(text).cast("bigint").alias("chars"))


def rebuilt(conversations: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, h1, h2, chars, n) of the rebuilt conversations, and (conv_id, n) of all, turnless too.

    A conversation gets the first turns of its block's first in place of as many of its own.
    """
    own = work.write(placed(hashed(conversations), ["conv_id"], ["turn", "h1", "h2"], "pos", "size"), "own")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = own.where("pos = 1").select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), shared.alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = work.write(convs.withColumn("n", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "convs")
    # at most SHARED - 1 turns of a base, for at most BLOCK conversations
    heads = own.where(f"pos < {SHARED} and conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "chars")
    lent = convs.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "h1", "h2", "chars", "n")
    kept = own.join(convs.select("conv_id", "h", "taken", "n"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "h1", "h2", "chars", "n")
    return lent.unionByName(kept), convs.select("conv_id", "n")


def accumulated(rows: DataFrame, keys: Sequence[str], place: str, names: Sequence[str], long: Column, fold: Callable[[str], Column], add: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with each named column folded over the rows of its keys up to it.

    Windows see RUN places of a key at most; what precedes them is folded by itself for the keys that have more,
    which `long` marks.
    """
    cut = F.floor(F.col(place) / RUN)
    w = Window.partitionBy(*keys, "__cut").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("__cut", cut).withColumns({n: fold(n).over(w) for n in names})
    parts = rows.where(long).groupBy(*keys, cut.alias("__cut")).agg(*[fold(n).alias(n) for n in names])
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__cut", *[F.coalesce(fold(n).over(before), F.lit(0)).alias(f"__{n}") for n in names])
    out = own.join(parts, [*keys, "__cut"], "left").withColumns({n: add(F.col(n), F.coalesce(f"__{n}", F.lit(0))) for n in names})
    return out.drop("__cut", *[f"__{n}" for n in names])


def keyed(turns: DataFrame) -> DataFrame:
    """turns with z1, z2 (a turn's hashes at its depth) and k1, k2 (those of the prefix that ends with it)."""
    z = {f"z{k}": F.xxhash64(F.lit(k), "depth", "h1", "h2") for k in (1, 2)}
    rows = turns.withColumns(z).withColumns({"k1": F.col("z1"), "k2": F.col("z2")}).drop("h1", "h2")
    return accumulated(rows, ["conv_id"], "depth", ["k1", "k2"], F.col("n") >= RUN, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def peeled(vertices: DataFrame, work: Workspace) -> DataFrame:
    """(a, b, leaves, saved) of each vertex: sums over its subtree.

    vertices has a and b, its key; up_a and up_b, its parent's, null at the root; waits, the number of its
    children; and its own leaves and saved.
    """
    state, done, k = work.write(vertices, "peel-0"), None, 0
    while True:
        ready = state.where("waits = 0")
        done = ready if done is None else done.unionByName(ready)
        if state.where("waits > 0").isEmpty():
            return done.select("a", "b", "leaves", "saved")
        sent = ready.where("up_a is not null").groupBy(F.col("up_a").alias("to_a"), F.col("up_b").alias("to_b"))
        sent = sent.agg(F.count("*").alias("came"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        pending = state.where("waits > 0").join(sent, (F.col("a") == F.col("to_a")) & (F.col("b") == F.col("to_b")), "left")
        or0 = lambda c: F.coalesce(c, F.lit(0))
        after = pending.select("a", "b", "up_a", "up_b", (F.col("waits") - or0("came")).alias("waits"), (F.col("leaves") + or0("more_leaves")).alias("leaves"), (F.col("saved") + or0("more_saved")).alias("saved"))
        k += 1
        state = work.write(after, f"peel-{k}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, k1, k2, ends_sha256) from pieces of text, in order of node and piece."""
    names = [*_NODE, "ends_sha256"]
    now, running = None, None
    for batch in batches:
        out = []
        for *node, text in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "piece_text"]), strict=True):
            if node == now:
                running.update(b",")
            else:
                if now:
                    out.append((*now, running.hexdigest()))
                now, running = node, hashlib.sha256()
            running.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, running.hexdigest())], names=names)


def ends(last: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end, from (depth, k1, k2, conv_id) of each."""
    rows = placed(last, _NODE, ["conv_id"], "at", "size").withColumn("piece", F.floor((F.col("at") - 1) / PIECE))
    texts = rows.groupBy(*_NODE, "size", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece_text"))
    one = texts.where(f"size <= {PIECE}").select(*_NODE, F.sha2(F.col("piece_text").cast("binary"), 256).alias("ends_sha256"))
    many = texts.where(f"size > {PIECE}").repartition(*_NODE).sortWithinPartitions(*_NODE, "piece").select(*_NODE, "piece_text")
    return one.unionByName(many.mapInArrow(bt.lean(_digests), "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (what sharing each turn of its subtree saves, in code points) and ends_sha256."""
    work = Workspace(spark, "trie")
    turns, convs = rebuilt(conversations, work)
    rows = work.write(keyed(turns), "turns")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[F.lit(0).cast("bigint").alias(c) for c in _NODE], "n_convs", "conv_id", F.lit(0).cast("bigint").alias("chars"), *[F.lit(None).cast("bigint").alias(c) for c in ("u1", "u2")])
    found = rows.groupBy(*_NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), *[F.min(F.col(f"k{k}").bitwiseXOR(F.col(f"z{k}"))).alias(f"u{k}") for k in (1, 2)])
    nodes = work.write(found.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    linked = work.write(nodes.join(parents, ["depth", "u1", "u2"], "left").drop("u1", "u2"), "linked")

    # runs of nodes with the same members: only the top one's parent has more
    above = lambda c: F.max(F.when(F.col("parent_n") > F.col("n_convs"), F.col(c)))
    runs = linked.groupBy(F.col("conv_id").alias("a"), F.col("n_convs").alias("b")).agg(above("parent_conv_id").alias("up_a"), above("parent_n").alias("up_b"), F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("own").alias("saved"))
    runs = work.write(runs, "runs")
    children = runs.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("waits"))
    runs = work.write(runs.join(children, ["a", "b"], "left").withColumn("waits", F.coalesce("waits", F.lit(0))), "counted")
    totals = peeled(runs.select("a", "b", "up_a", "up_b", "waits", F.when(F.col("waits") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), "saved"), work)
    totals = totals.join(runs.select("a", "b", "top", "bottom", "waits"), ["a", "b"]).withColumnsRenamed({"a": "conv_id", "b": "n_convs"})

    inside = accumulated(linked.join(totals, ["conv_id", "n_convs"]).withColumn("upto", F.col("own")), ["conv_id", "n_convs"], "depth", ["upto"], F.floor(F.col("top") / RUN) < F.floor(F.col("bottom") / RUN), F.sum, lambda a, b: a + b)
    ended = ends(rows.where("depth = n").select(*_NODE, "conv_id").unionByName(convs.where("n = 0").select(*[F.lit(0).cast("bigint").alias(c) for c in _NODE], "conv_id")))
    out = inside.join(ended, _NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.when(F.col("depth") == F.col("bottom"), F.col("waits")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("upto") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
