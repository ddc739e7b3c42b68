"""Keyed state of streams: buffers of rewards by target, and a queue of retries on timers.

Both live in the state store (RocksDB) of one streaming query and follow its checkpoint: a run that is stopped goes
on where it was, a batch that runs again starts from the state before it, and a lost executor costs its partitions'
last batch. Buffers are kept as a map of chunks, one for each batch that brought rows, so a batch reads a target's
buffer once, adds one chunk and drops those that have become too old, whatever the buffer's size.

Rows of a target in one batch are held by one task, which puts them in order; the source's options (files or bytes a
trigger) bound a batch. Rows of equal seq keep the order of their energy and key. Null targets are a target. Null
energies have a null percentile and do not count; null keys are a key.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelode.functions import expressions as E
from tidelode.operators import reward

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one and states in RocksDB; this one's settings stay as they are."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return own


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that its source has now, appending to a folder of Parquet."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Chunks:
    """A buffer of the newest `keep` values in a map state, chunk by chunk."""

    def __init__(self, state, keep: int):
        self.state, self.keep = state, keep
        found = sorted((int(k[0]), list(v[0])) for k, v in state.iterator()) if state.exists() else []
        self.chunks = deque(found)
        self.size = sum(len(v) for _, v in found)

    def values(self) -> list:
        return [x for _, v in self.chunks for x in v]

    def add(self, values: list) -> None:
        if not values:
            return
        number = self.chunks[-1][0] + 1 if self.chunks else 0
        self.chunks.append((number, values))
        self.size += len(values)
        changed = {number}
        while self.size > self.keep:
            first, old = self.chunks.popleft()
            over = min(len(old), self.size - self.keep)
            self.size -= over
            if over < len(old):
                self.chunks.appendleft((first, old[over:]))
                changed.add(first)
            elif first in changed:
                changed.discard(first)
            else:
                self.state.removeKey((first,))
        for k, v in self.chunks:
            if k in changed:
                self.state.updateValue((k,), (v,))

    def clear(self) -> None:
        self.chunks.clear()
        self.size = 0
        self.state.clear()


class RewardMemory(StatefulProcessor):
    """Percentiles and novelty of a target's rows against what its earlier batches left.

    Rows of one batch are ranked by the buffer as it was before the batch; without one, by all energies of the batch,
    which then also stay in it in front of those that pass (`seeded`), as the original program has it. A row is a
    duplicate if its key is among the last `keep_keys` keys of rows that passed. A row with `reset` forgets the
    target's buffers at its place in the order; the rows behind it are a first batch again.
    """

    OUT = "target string, seq bigint, percentile double, duplicate_flag int, gate_reason string, r_geom double, r_comp double"

    def __init__(self, keep_energies: int, keep_keys: int, seeded: bool = True):
        self.keep_energies, self.keep_keys, self.seeded = keep_energies, keep_keys, seeded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.energies = handle.getMapState("energies", "chunk bigint", "vals array<double>")
        self.keys = handle.getMapState("keys", "chunk bigint", "vals array<string>")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Rows of (target, seq, e_per_atom, struct_key): buffers of an earlier run; null cells are none."""
        rows = initialState.sort_values("seq", kind="stable")
        _Chunks(self.energies, self.keep_energies).add([float(x) for x in rows["e_per_atom"].dropna()])
        _Chunks(self.keys, self.keep_keys).add([str(x) for x in rows["struct_key"].dropna()])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seq", "e_per_atom", "struct_key"], kind="stable")
        marks = np.flatnonzero(frame["reset"].fillna(False).to_numpy(bool))
        energies, keys = _Chunks(self.energies, self.keep_energies), _Chunks(self.keys, self.keep_keys)
        begin = 0
        for end in [*marks.tolist(), len(frame)]:
            if begin < end:
                yield self._scored(frame.iloc[begin:end], energies, keys)
            if end < len(frame):
                energies.clear()
                keys.clear()
            begin = end + 1

    def _scored(self, part: pd.DataFrame, energies: _Chunks, keys: _Chunks) -> pd.DataFrame:
        own = part["e_per_atom"].to_numpy(float)
        known = np.isfinite(own)
        passed = part["gate_reason"].isna().to_numpy()
        before = energies.values()
        base = np.sort(np.array(before or own[known], float))
        below = np.searchsorted(base, own, side="left")
        share = below / (len(base) - 1) if len(base) > 1 else np.full(len(own), 0.5)
        added = own[known & passed].tolist()
        energies.add((own[known].tolist() if not before and self.seeded else []) + added)
        # places of keys among those that passed, those in the buffer in front
        old = keys.values()
        last = {k: p for p, k in enumerate(old)}
        flags: list[int | None] = []
        at, new = len(old), []
        for k, ok in zip(part["struct_key"].tolist(), passed.tolist(), strict=True):
            if not ok:
                flags.append(None)
                continue
            flags.append(int(k in last and at - last[k] <= self.keep_keys))
            last[k] = at
            new.append(k)
            at += 1
        keys.add(new)
        out = part[["target", "seq", "gate_reason", "r_geom", "r_comp"]].copy()
        out["percentile"] = pd.Series(np.where(known, share, np.nan), index=out.index).astype(object).where(known, None)
        out["duplicate_flag"] = pd.Series(flags, index=out.index, dtype=object)
        return out[["target", "seq", "percentile", "duplicate_flag", "gate_reason", "r_geom", "r_comp"]]

    def close(self) -> None:
        pass


def reward_stream(source: DataFrame, weights: reward.Weights | None = None, least_distance: float = 0.5, keep_energies: int = 50_000, keep_keys: int = 2_000, seeded: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """Rewards of a stream of structures (the columns of `reward.composite`, and reset), with state by target.

    initial: rows (target, seq, e_per_atom, struct_key) of buffers to begin with. Rows with reset give no reward.
    """
    rows = source.withColumns({
        "gate_reason": reward.gate_reason(F.col("min_distance"), F.col("density"), least_distance),
        "r_geom": E.r_geom(F.col("min_distance"), least_distance, F.col("density"), F.col("ref_density"), F.col("mean_cn"), F.col("max_cn")),
        "r_comp": E.r_comp(F.col("same"), F.col("cosine"), F.col("target_elements"), F.col("elements")),
    }).select("target", F.col("seq").cast("bigint"), F.col("e_per_atom").cast("double"), "struct_key", F.coalesce("reset", F.lit(False)).alias("reset"), "gate_reason", "r_geom", "r_comp")
    memory = RewardMemory(keep_energies, keep_keys, seeded)
    ranked = rows.groupBy("target").transformWithStateInPandas(memory, RewardMemory.OUT, "append", "none", initialState=initial.groupBy("target") if initial is not None else None)
    ok = F.col("gate_reason").isNull()
    parts = {"r_proxy": E.r_proxy(F.col("percentile")), "r_geom": F.col("r_geom"), "r_comp": F.col("r_comp"), "r_novel": 1.0 - F.col("duplicate_flag")}
    shares = (weights or reward.Weights()).shares()
    out = ranked.withColumns({k: F.when(ok, v) for k, v in parts.items()})
    total = F.when(ok, E.r_total([F.col(k) for k in parts], shares)).otherwise(-1.0)
    return out.withColumns({"r_total": total, "gate_failed": (~ok).cast("int")})


def buffer_sizes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(target, energies, keys): entries of each target's buffers in the state that a checkpoint has, read as a table."""

    def sizes(name: str) -> DataFrame:
        state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        return state.groupBy(F.col("key.target").alias("target")).agg(F.sum(F.size("user_map_value.vals")).alias(name))

    both = sizes("energies").join(sizes("keys").withColumnRenamed("target", "__t"), F.col("target").eqNullSafe(F.col("__t")), "full")
    return both.select(F.coalesce("target", "__t").alias("target"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("energies", "keys")])


# --- retries


def hashed_unit(seed: int, key: int, place: int) -> float:
    """A number from 0 up to 1 by md5, which any engine can repeat."""
    return int(hashlib.md5(f"{seed}|{key}|{place}".encode()).hexdigest()[:8], 16) / 4294967296.0  # noqa: S324


def unit_column(seed: int, key: Column, place: int) -> Column:
    """The same as a column."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key, F.lit(place))), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Identifiers in a row that share one entry of the state.
LOT = 1024


class RetryQueue(StatefulProcessor):
    """Attempts at a piece of work, each failure followed by a wait that doubles and by cooler settings of its own.

    Input: id, at_ms (when it arrives), temperature, top_k, by lots of LOT identifiers in a row. Of an identifier that is
    known already nothing is done. Output: one row for each attempt: attempt (from 1), its settings, due_ms and whether
    it succeeded. The state of a lot is a list of its identifiers with what each of them waits for (nothing is due once
    it is over), so a lot is read and written once a batch, and has one timer, for the first that is due; timers follow
    the watermark of event time.
    """

    OUT = "id bigint, attempt int, temperature double, top_k int, due_ms bigint, ok boolean"
    STATE = "ids array<bigint>, attempts array<int>, temperatures array<double>, top_ks array<int>, dues array<bigint>, over array<boolean>"

    def __init__(self, attempt: Callable[[int, int, float, int], bool], most: int, wait_ms: int):
        self.attempt, self.most, self.wait_ms = attempt, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", self.STATE)

    def _known(self) -> dict[int, tuple]:
        """Of each known identifier: attempt, temperature, top_k, due, over."""
        if not self.waiting.exists():
            return {}
        ids, *fields = self.waiting.get()
        return dict(zip(ids, zip(*fields, strict=True), strict=True))

    def _keep(self, known: dict[int, tuple], before: int | None) -> None:
        """Writes the state; before is the time that the lot's timer was set to."""
        self.waiting.update((list(known), *[list(x) for x in zip(*known.values(), strict=True)]))
        first = self._first(known)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if first is not None:
                self.handle.registerTimer(first)

    @staticmethod
    def _first(known: dict[int, tuple]) -> int | None:
        return min((due for *_, due, over in known.values() if not over), default=None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("at_ms", kind="stable").drop_duplicates("id")
        known, made, now = self._known(), [], timerValues.getCurrentWatermarkInMs()
        before, n = self._first(known), len(known)
        for id_, at, temperature, top_k in zip(*[frame[c].tolist() for c in ("id", "at_ms", "temperature", "top_k")], strict=True):
            if id_ not in known:
                known[id_] = self._go(made, id_, 1, float(temperature), int(top_k), int(at), now)
        if len(known) > n:
            self._keep(known, before)
            yield self._frame(made)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known, made, now = self._known(), [], timerValues.getCurrentWatermarkInMs()
        for id_, (attempt, temperature, top_k, due, over) in known.items():
            if not over and due <= now:
                known[id_] = self._go(made, id_, attempt, temperature, top_k, due, now)
        if made:
            self._keep(known, None)  # the timer that expired is gone
            yield self._frame(made)

    def _go(self, made: list[tuple], id_: int, attempt: int, temperature: float, top_k: int, due: int, now: int) -> tuple:
        """Makes the attempt that is due, and those that have become due since; returns what the identifier waits for."""
        while True:
            ok = self.attempt(id_, attempt, temperature, top_k)
            made.append((id_, attempt, temperature, top_k, due, ok))
            if ok or attempt >= self.most:
                return attempt, temperature, top_k, due, True
            due += self.wait_ms << (attempt - 1)
            attempt, temperature, top_k = attempt + 1, *cooled(temperature, top_k)
            if due > now:
                return attempt, temperature, top_k, due, False

    @staticmethod
    def _frame(made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(made, columns=["id", "attempt", "temperature", "top_k", "due_ms", "ok"])

    def close(self) -> None:
        pass


def cooled(temperature: float, top_k: int) -> tuple[float, int]:
    """Settings of the next attempt."""
    return max(0.6, temperature * 0.8), max(5, top_k // 2)


def retry_stream(source: DataFrame, attempt: Callable[[int, int, float, int], bool], most: int, wait_ms: int, late: str = "0 seconds") -> DataFrame:
    """One row for each attempt at each id of a stream of (id, at, temperature, top_k)."""
    rows = source.where("id is not null").withWatermark("at", late).withColumns({"at_ms": F.unix_millis("at"), "lot": F.floor(F.col("id") / LOT)})
    return rows.groupBy("lot").transformWithStateInPandas(RetryQueue(attempt, most, wait_ms), RetryQueue.OUT, "append", "eventTime")
