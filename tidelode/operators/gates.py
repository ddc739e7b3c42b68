"""Quality gates and resumable phases. A gate reads one aggregate row and decides on the driver."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.functions.expressions import non_empty
from tidelode.operators.stats import rate

_LOG = logging.getLogger(__name__)


class GateError(RuntimeError):
    """A gate that stops the run."""


class FailRate(NamedTuple):
    passed: bool
    rate: float
    failed: int
    total: int


def fail_rates(scores: DataFrame, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total and failed (blank) scores and their rate, over all rows or by keys."""
    failed = F.count_if(~non_empty(F.col(score).cast("string")))
    return scores.groupBy(*keys).agg(F.count("*").alias("total"), failed.alias("failed"), rate(failed, F.count("*")).alias("fail_rate"))


def fail_rate_gate(scores: DataFrame, score: str, most: float = 0.05, mode: str = "warn") -> FailRate:
    """Whether few enough rows failed. Mode off passes always, warn logs, fail decides; no rows pass."""
    if mode not in ("off", "warn", "fail"):
        raise ValueError(f"unknown gate mode {mode!r}")
    total, failed, share = fail_rates(scores, score).head()
    over = share > most
    if over and mode == "warn":
        _LOG.warning("%d of %d scores failed, more than %.3f", failed, total, most)
    return FailRate(not (over and mode == "fail"), share, failed, total)


def spread_gate(std: float | None, least: float = 0.05) -> bool:
    """Whether rewards differ enough to rank by; an unknown deviation does not pass."""
    return std is not None and std >= least


def at_least(name: str, found: int, least: int) -> None:
    """A hard gate on a count."""
    if found < least:
        raise GateError(f"{name}: {found}, at least {least} are needed")


def early_warning(found: int, asked: int) -> bool:
    """Logs and tells if fewer than half of the rows asked for are there."""
    few = found < asked / 2
    if few:
        _LOG.warning("only %d of %d rows so far", found, asked)
    return few


def availability(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """Rows there, asked for, missing, and whether they suffice."""
    have = F.coalesce(F.sum(n), F.lit(0))
    return counts.agg(have.alias("available"), F.lit(total).cast("bigint").alias("required"), F.greatest(F.lit(total) - have, F.lit(0)).alias("shortfall"), (have >= total).alias("enough"))


def best_path(*paths: str | None, exists: Callable[[str], bool]) -> str:
    """The first path that exists, as best before final; an error without any."""
    for p in paths:
        if p and exists(p):
            return p
    raise GateError(f"none of {paths} exists")


@dataclass
class Phases:
    """Phases of a run, each with a marker that it writes when done; a phase is skipped only if its marker is
    there and its results still pass its check."""

    spark: SparkSession
    root: str

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def done(self, phase: str) -> bool:
        fs, path = self._file(f"_markers/{phase}")
        return bool(fs.exists(path))

    def run(self, phase: str, work: Callable[[], object], valid: Callable[[], bool] = lambda: True) -> bool:
        """Runs a phase unless it is done and valid; tells whether it ran."""
        if self.done(phase) and valid():
            return False
        self.clear(phase)
        work()
        if not valid():
            raise GateError(f"phase {phase} left results that its check rejects")
        fs, path = self._file(f"_markers/{phase}")
        fs.create(path, True).close()
        return True

    def clear(self, phase: str) -> None:
        """Removes a phase's marker and its folder of results."""
        for name in (f"_markers/{phase}", phase):
            fs, path = self._file(name)
            fs.delete(path, True)
