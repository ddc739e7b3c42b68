"""Shared storage and size-checked broadcasts for operators that run in several steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows times their width stay below this.
BROADCAST_BYTES = 8 << 20

_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: Set where the cluster names no shared folder, as in local tests.
_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or in local sessions without it a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tidelode-"))
    return _LOCAL[0]


#: Workspaces of the runs that are open, the innermost last.
_RUNS: list[list[Workspace]] = []


@contextmanager
def run_folders() -> Iterator[None]:
    """Deletes at its end the folders of all operators that were called inside.

    Results are read from these folders, so write or collect them inside:

        with run_folders():
            query(spark, sf_dir).write.parquet(out)
    """
    _RUNS.append([])
    try:
        yield
    finally:
        for work in _RUNS.pop():
            work.drop()


class Workspace:
    """A folder of one operator run, holding the written tables that cut its lineage.

    Written tables survive lost executors and are read by column, unlike cached blocks. The folder
    stays until `drop()` or the end of `run_folders()`, as the operator's result is read from it lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/tidelode/{name}-{uuid.uuid4().hex}"
        if _RUNS:
            _RUNS[-1].append(self)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet once and returns what was written.

        Arrow batches are kept small meanwhile: each task holds some on both sides of its pipe.
        """
        before = {k: self.spark.conf.get(k) for k in _BATCHES}
        for k, v in _BATCHES.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(self.at(name))
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str = "") -> None:
        """Deletes the folder, or one table in it that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_keyed(docs: DataFrame, work: Workspace) -> tuple[DataFrame, str]:
    """docs, and the column that tells its rows apart: doc_id, or row__ where ids repeat or are null.

    docs is then written with row__, which follows doc_id (nulls last) and the digest of the text.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.sha2(F.col("text").cast("binary"), 256))
    return work.write(rows.withColumn("row__", F.monotonically_increasing_id()), "row-keyed"), "row__"


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if counting shows it to be small; else as it is, to be shuffled.

    df must be cheap to count: a written table.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
