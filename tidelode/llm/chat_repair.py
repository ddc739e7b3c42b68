"""Chat formatting: repair of turn orders at least cost, then rendering in a chat template.

A legal conversation is an optional system turn, then user and assistant turns in alternation, beginning
with the user and ending with the assistant. Each turn of the input is kept, given another role, or merged
into the turn in front of it; an empty turn may be put in front of it or at the end. Every choice has a
cost, and the repair is the cheapest path through the automaton of legal turns (four states: start, system,
user, assistant).

Costs of paths are combined by (min, +), which is associative. So turns are cut into blocks of bounded size
wherever a conversation is long: each block gives the cost from every state to every state, a pass over the
few blocks of a conversation fixes the costs in front of each, each block then tells for every state behind it
the one that its best path comes from, a pass back fixes the state behind each block, and each block traces its
own part of the path. No conversation is gathered in one task, and its rendering is returned in pieces, one for
each turn, which in order of turns make up the text. Conversations of one block need the last step only.

Of paths with equal costs the one is taken whose last turn has the first choice in the order keep, merge,
relabel, with fewer empty turns first; then the turn before it, and so on. Blocks do not change that choice.

Defined cases: a null or unknown role, or one of more than LONGEST_ROLE characters, can be given any role at
UNKNOWN_COST; a null text is empty; equal turn numbers are ordered by the digest of role and text; a null conv_id is
a conversation; rows that repeat are turns of their own; an empty table gives no rows; a very long text is written
once, held by one task at a time as its piece, and never sorted by nor sampled for a sort. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm.workspace import Workspace

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
#: Costs of merging a turn into the one in front, of another role, of a role where none is known, and of
#: an empty turn.
MERGE_COST, RELABEL_COST, UNKNOWN_COST, EMPTY_COST = 1.0, 2.0, 1.0, 3.0
#: Turns of a block, turns that one task is meant for, and traces that a task remembers.
BLOCK, TASK_TURNS, REMEMBER = 256, 100_000, 20_000
#: Characters of a role that can be a known one.
LONGEST_ROLE = 256

_INF = float("inf")
#: States that may follow each state.
_AFTER = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _gaps() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each state and the next one, the fewest empty turns that must stand between."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for a in range(4):
        paths: list[tuple[int, tuple[int, ...]]] = [(a, ())]
        for _ in range(4):
            for at, between in paths:
                for b in _AFTER[at]:
                    out.setdefault((a, b), between)
            paths = [(b, (*between, b)) for at, between in paths for b in _AFTER[at]]
    return out


GAPS = _gaps()


class Step:
    """One way to take a turn from state a: to state b, with empty turns in front, as another role or not."""

    __slots__ = ("action", "b", "cost", "empty", "rank")

    def __init__(self, b: int, cost: float, action: str, empty: tuple[int, ...]):
        self.b, self.cost, self.action, self.empty = b, cost, action, empty
        self.rank = (("keep", "merge", "relabel").index(action), len(empty))


def _steps(role: int) -> dict[int, list[Step]]:
    """All ways to take a turn of a role (0 if it is unknown) from each state."""
    out: dict[int, list[Step]] = {}
    for a in range(4):
        own = []
        for b in (SYSTEM, USER, ASSISTANT):
            price = 0.0 if b == role else UNKNOWN_COST if role == START else RELABEL_COST
            action = "keep" if b == role else "relabel"
            if (a, b) in GAPS:
                own.append(Step(b, price + EMPTY_COST * len(GAPS[a, b]), action, GAPS[a, b]))
            if a == b:
                own.append(Step(b, MERGE_COST + price, "merge", ()))
        out[a] = own
    return out


STEPS = {role: _steps(role) for role in range(4)}
#: Empty turns at the end, by the last state.
ENDS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def block_costs(roles: list[int]) -> np.ndarray:
    """Least costs from each state in front of a run of turns to each state behind it."""
    cost = np.full((4, 4), _INF)
    np.fill_diagonal(cost, 0.0)
    for role in roles:
        after = np.full((4, 4), _INF)
        for a, steps in STEPS[role].items():
            for s in steps:
                np.minimum(after[:, s.b], cost[:, a] + s.cost, out=after[:, s.b])
        cost = after
    return cost


def forward(roles: tuple[int, ...], entry: tuple[float, ...]) -> list[tuple[float, ...]]:
    """Least costs of each state in front of a run of turns, given those at its entry, and behind each turn."""
    out = [entry]
    for role in roles:
        cost, after = out[-1], [_INF] * 4
        for a, steps in STEPS[role].items():
            for s in steps:
                if cost[a] + s.cost < after[s.b]:
                    after[s.b] = cost[a] + s.cost
        out.append(tuple(after))
    return out


def _back(roles: tuple[int, ...], costs: list[tuple[float, ...]], last: int) -> tuple[list[Step], int]:
    """The best path over a run of turns that ends in a state, and the state that it comes from."""
    path: list[Step] = []
    state = last
    for k in range(len(roles), 0, -1):
        before, want = costs[k - 1], costs[k][state]
        ways = [(s.rank, a, s) for a, steps in STEPS[roles[k - 1]].items() for s in steps if s.b == state and before[a] + s.cost == want]
        _, state, step = min(ways, key=lambda x: x[:2])
        path.append(step)
    return path[::-1], state


@lru_cache(maxsize=REMEMBER)
def trace(roles: tuple[int, ...], entry: tuple[float, ...], last: int) -> tuple[Step, ...]:
    """The best path over a run of turns from the costs at its entry to the state behind it."""
    return tuple(_back(roles, forward(roles, entry), last)[0])


@lru_cache(maxsize=REMEMBER)
def ending(roles: tuple[int, ...], entry: tuple[float, ...]) -> tuple[float, int]:
    """Least cost of a conversation that ends with these turns, and its last state."""
    return last_state(forward(roles, entry)[-1])


def last_state(cost: tuple[float, ...]) -> tuple[float, int]:
    total = [cost[s] + EMPTY_COST * len(ENDS[s]) for s in range(4)]
    return min(total), total.index(min(total))


def sources(roles: tuple[int, ...], entry: tuple[float, ...]) -> list[int]:
    """For each state behind a run of turns the one in front that the best path to it comes from, -1 for none."""
    costs = forward(roles, entry)
    return [_back(roles, costs, s)[1] if costs[-1][s] < _INF else -1 for s in range(4)]


#: Costs of the states where a conversation begins.
ENTRY = (0.0, _INF, _INF, _INF)


def entries(blocks: list[np.ndarray]) -> list[tuple[float, ...]]:
    """Costs of the states in front of each block of a conversation, and behind the last."""
    out = [ENTRY]
    for m in blocks:
        out.append(tuple((np.array(out[-1])[:, None] + m).min(axis=0).tolist()))
    return out


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else START


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Runs of rows with the same keys, as lists by column; the rows of a partition are sorted by them."""
    held: dict[str, list] = {}
    last: tuple | None = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        marks = list(zip(*(cols[k] for k in keys), strict=True))
        cut = [k for k in range(len(marks)) if marks[k] != (marks[k - 1] if k else last)]
        edges = [0, *[k for k in cut if k], len(marks)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if held and marks[lo] != last:
                yield held
                held = {}
            for n, v in cols.items():
                held.setdefault(n, []).extend(v[lo:hi])
            last = marks[lo]
    if held:
        yield held


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows of about `most` to a batch."""
    held: list[tuple] = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield out()
            held = []
    if held:
        yield out()


_COSTS = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.float64()))])
_ENTRY = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.list_(pa.float64()))])
_SOURCE = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.list_(pa.float64())), ("source", pa.list_(pa.int32())), ("behind", pa.list_(pa.float64()))])
_LAST = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.list_(pa.float64())), ("last", pa.int32()), ("cost", pa.float64()), ("final", pa.bool_())])


def _roles(names: list[str | None]) -> tuple[int, ...]:
    return tuple(map(_role, names))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(((x["conv"][0], x["block"][0], block_costs(list(_roles(x["known"]))).ravel().tolist()) for x in _blocks(batches, ("conv", "block"))), _COSTS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for x in _blocks(batches, ("conv",)):
            found = entries([np.array(c).reshape(4, 4) for c in x["costs"]])
            yield from zip(x["conv"], x["block"], map(list, found[:-1]), strict=True)

    yield from _batched(rows(), _ENTRY)


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for x in _blocks(batches, ("conv", "block")):
            roles, entry = _roles(x["known"]), tuple(x["entry"][0])
            yield x["conv"][0], x["block"][0], list(entry), sources(roles, entry), list(forward(roles, entry)[-1])

    yield from _batched(rows(), _SOURCE)


def _lasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind each block, from the last one back."""

    def rows() -> Iterator[tuple]:
        for x in _blocks(batches, ("conv",)):
            n = len(x["block"])
            cost, state = last_state(tuple(x["behind"][-1]))
            lasts = [state]
            for k in range(n - 1, 0, -1):
                lasts.append(x["source"][k][lasts[-1]])
            for k, state in enumerate(reversed(lasts)):
                yield x["conv"][k], x["block"][k], x["entry"][k], state, cost, k == n - 1

    yield from _batched(rows(), _LAST)


def render_head(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


END = "<|end|>\n"


_TURNS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("out_role", pa.string()), ("action", pa.string()), ("n_empty", pa.int32()), ("opened", pa.int32()), ("cost", pa.float64()),
    ("piece", pa.string()),
])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of blocks. A turn's piece closes the turn in front of it, unless it is merged into that."""

    def rows() -> Iterator[tuple]:
        for x in _blocks(batches, ("conv", "block")):
            roles, n = _roles(x["known"]), len(x["role"])
            if x["entry"][0] is None:  # the conversation has one block
                entry, final = ENTRY, True
                cost, last = ending(roles, entry)
            else:
                entry, last, cost, final = tuple(x["entry"][0]), x["last"][0], x["cost"][0], x["final"][0]
            for k, (step, text) in enumerate(zip(trace(roles, entry, last), x["text"], strict=True)):
                text = text or ""
                if step.action == "merge":
                    piece, opened = "\n" + text, 0
                else:
                    close = END if x["place"][k] else ""
                    piece, opened = close + "".join(render_head(r) + END for r in step.empty) + render_head(step.b) + text, 1 + len(step.empty)
                if final and k == n - 1:
                    piece += END + "".join(render_head(r) + END for r in ENDS[step.b])
                yield x["conv"][k], x["turn"][k], x["place"][k], x["role"][k], ROLES[step.b - 1], step.action, len(step.empty), opened, cost, piece

    yield from _batched(rows(), _TURNS)


def repaired(spark: SparkSession, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each turn of turns(conv_id, turn, role, text): conv_id, turn, place (from 0), role,
    out_role, action, n_empty (empty turns put in front), opened (turns that the piece opens), cost (of the
    conversation's repair) and piece (its part of the rendering)."""
    work = Workspace(spark, "chat-repair")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    texts = work.write(rows.withColumn("key", F.monotonically_increasing_id()), "turns")
    # places by counting, block by block of turn numbers: a range sort of keys, not one task for a conversation
    digest = F.substring(F.unhex(F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary"), 256)), 1, 16)
    keys = texts.select("conv", "turn", digest.alias("digest"), "key", F.when(F.length("role") <= LONGEST_ROLE, F.col("role")).alias("known"))
    order = ["conv", "turn", "digest", "key"]
    ranged = work.write(keys.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id()), "sorted")
    # of each part and conversation: its first row there, and how many rows of it stand in parts before
    parts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("within").alias("begin"))
    before = F.sum("n").over(_window()) - F.col("n")
    parts = work.write(parts.select("conv", "part", "begin", before.alias("before")), "parts")
    named = parts.withColumnsRenamed({"conv": "p_conv", "part": "p_part"})
    placed = ranged.join(named, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part"))).select("conv", "key", "known", (F.col("within") - F.col("begin") + F.col("before")).alias("place"))
    placed = work.write(placed.withColumn("block", F.floor(F.col("place") / block)), "placed")
    tasks = max(spark.sparkContext.defaultParallelism, -(-placed.count() // TASK_TURNS))
    convs = lambda df: df.repartition(tasks, "conv").sortWithinPartitions("conv", "block")
    blocks = lambda df: df.repartition(tasks, "conv", "block").sortWithinPartitions("conv", "block", "place")
    # conversations of several blocks: costs, then states, at each border
    long = placed.groupBy("conv").agg(F.max("block").alias("b")).where("b > 0").select(F.col("conv").alias("l_conv"))
    turns_ = placed.join(long, F.col("conv").eqNullSafe(F.col("l_conv")), "left_semi").select("conv", "block", "place", "known")
    turns_ = work.write(turns_, "long")
    # texts meet their places once, by key
    columns = placed.join(texts.drop("conv"), "key").select("conv", "block", "place", "turn", "role", "known", "text")
    if turns_.isEmpty():
        full = columns.withColumns({"entry": F.lit(None).cast("array<double>"), "last": F.lit(None).cast("int"), "cost": F.lit(None).cast("double"), "final": F.lit(None).cast("boolean")})
    else:
        costs = blocks(turns_).mapInArrow(_costs, "conv bigint, block bigint, costs array<double>")
        entry = convs(costs).mapInArrow(_entries, "conv bigint, block bigint, entry array<double>")
        found = blocks(_with(turns_, entry, "inner")).mapInArrow(_sources, "conv bigint, block bigint, entry array<double>, source array<int>, behind array<double>")
        lasts = work.write(convs(found).mapInArrow(_lasts, "conv bigint, block bigint, entry array<double>, last int, cost double, final boolean"), "borders")
        full = _with(columns, lasts, "left")
    return blocks(full).mapInArrow(_rendered, "conv_id bigint, turn bigint, place bigint, role string, out_role string, action string, n_empty int, opened int, cost double, piece string")


def _with(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """rows joined to a table of blocks."""
    named = table.withColumnsRenamed({"conv": "e_conv", "block": "e_block"})
    return rows.join(named, F.col("conv").eqNullSafe(F.col("e_conv")) & (F.col("block") == F.col("e_block")), how).drop("e_conv", "e_block")


def _window():
    from pyspark.sql import Window

    # rows here are parts of a conversation, at most one a partition
    return Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
