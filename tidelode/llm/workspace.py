"""Shared storage and size-checked broadcasts, as the rest of the engine has them."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession

from tidelode.scratch import BROADCAST_BYTES, Workspace, row_keyed, shared_root, sized

__all__ = ["BROADCAST_BYTES", "Workspace", "release", "row_keyed", "shared_root", "sized"]

#: Seconds between two releases.
RELEASE_SECONDS = 10.0
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Lets the driver's cleaner free what finished steps still hold on executors, broadcast tables and shuffle files.

    The cleaner acts on what the driver's collector has found unused, and a driver whose heap is not full seldom
    collects: over an operator of a hundred small joins the broadcasts of all of them stay in the executors' memory.
    """
    if time.monotonic() - _released[0] >= RELEASE_SECONDS:
        gc.collect()  # Python's references keep plans of the JVM alive
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()
