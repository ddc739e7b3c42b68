"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards, one Parquet file each. Shards of similar size form a tier;
once a tier has `fanout` shards, runs of them are merged into files of up to the target size, which join
the tier of their size, until no tier is full. A manifest lists the live shards. Each append and each
compaction writes its files first and then commits the next version of the manifest by renaming a complete
temporary file to a name that must not exist yet: of two writers one fails, and a reader sees either
version whole; an append that fails is committed again on the version that came first. Files of old versions
stay until `vacuum`. A writer claims its folder before it writes and gives the claim up after its commit, so
`vacuum` spares files that wait for theirs.

The driver handles names and sizes of shards, whose number is the data over the target size (plus less than
`fanout` a tier); rows are moved by tasks only, each merge reading and writing its own shards.

Defined cases: an empty arrival adds no shard but a version; nulls, repeated rows and any columns are kept
as they are; columns that a shard lacks are null. Texts of any length are rows like others: a shard is closed by its
bytes, so one very long text makes a shard of its own.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm.workspace import Workspace

#: Bytes of a file that compaction aims at, shards that fill a tier, and how much larger each tier is.
TARGET_BYTES, FANOUT, RATIO = 128 << 20, 4, 4
#: Merges that one compaction job carries out, and versions that an append tries to follow.
JOB_MERGES, TRIES = 512, 20
#: Seconds after which the claim of a writer that has not committed counts as given up.
CLAIM_SECONDS = 7 * 86400


@dataclass(frozen=True)
class Shard:
    """A live file: its path below the table's root, bytes and rows."""

    name: str
    size: int
    rows: int


class ConflictError(RuntimeError):
    """Another writer has committed the version first."""


class ShardedTable:
    """A folder of shards and manifests on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # ---- manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def shards(self, version: int | None = None) -> list[Shard]:
        """Live shards of a version, by default the last; none before the first."""
        known = self.versions()
        if version is None and not known:
            return []
        text = self.spark.read.text(f"{self.root}/manifest/{known[-1] if version is None else version:012d}.json", wholetext=True).head()[0]
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Makes shards the version after base, or raises ConflictError if there is one already."""
        body = json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]})
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifest/{base + 1:012d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(body.encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        context = gateway.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # without the option to overwrite, a rename onto an existing name fails
            context.rename(temporary, final, gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if not self._fs.exists(final):
                raise
            raise ConflictError(f"version {base + 1} exists") from e
        return base + 1

    # ---- writing

    def _written(self, df: DataFrame, folder: str) -> list[Shard]:
        """Writes df below the root and lists its files with their rows."""
        self._fs.mkdirs(self._path(f"{self.root}/claims"))
        self._fs.create(self._claim(folder), True).close()
        df.write.mode("error").parquet(f"{self.root}/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
        counts = {r.name: r.n for r in rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()}
        out = []
        files = self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
        while files.hasNext():
            f = files.next()
            full = f.getPath().toString()
            name = full[full.index(f"/{folder}/") + 1 :]
            if name.endswith(".parquet"):
                n = counts.get(f.getPath().getName(), 0)
                if n:
                    out.append(Shard(name, int(f.getLen()), int(n)))
                else:
                    self._fs.delete(f.getPath(), False)
        return sorted(out, key=lambda s: s.name)

    def _claim(self, folder: str):
        return self._path(f"{self.root}/claims/{folder.rpartition('/')[2]}")

    def append(self, arrival: DataFrame) -> int:
        """Adds the partitions of an arrival as shards, behind whatever versions come first meanwhile."""
        folder = f"shards/{uuid.uuid4().hex}"
        try:
            made = self._written(arrival, folder)
            for left in range(TRIES, 0, -1):
                base = max(self.versions(), default=0)
                live = self.shards(base) if base else []
                try:
                    return self.commit(base, live + made)
                except ConflictError:
                    if left == 1:
                        raise
        finally:
            self._fs.delete(self._claim(folder), False)
        raise AssertionError

    def tier(self, size: int) -> int:
        """Tiers count up from 0; files of the target size and above are in the last."""
        top = math.ceil(math.log(max(self.target, 2), RATIO))
        return top if size >= self.target // 2 else min(top - 1, int(math.log(max(size, 1), RATIO)))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of shards to merge now: of each full tier, in order of size, up to the target each."""
        top = self.tier(self.target)
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s.size), []).append(s)
        merges = []
        for level, members in sorted(tiers.items()):
            if level >= top or len(members) < self.fanout:
                continue
            run: list[Shard] = []
            filled = 0
            for s in sorted(members, key=lambda s: (s.size, s.name)):
                if run and filled + s.size > self.target:
                    merges.append(run)
                    run, filled = [], 0
                run.append(s)
                filled += s.size
            merges.append(run)
        return [m for m in merges if len(m) > 1]

    def compact(self) -> int:
        """Merges until no tier is full; one version for each round of merges. Returns the last version."""
        while True:
            base = max(self.versions(), default=0)
            live = self.shards(base) if base else []
            merges = self.plan(live)[:JOB_MERGES]
            if not merges:
                return base
            gone = {s.name for run in merges for s in run}
            folder = f"shards/{uuid.uuid4().hex}"
            try:
                made = self._merged(merges, folder)
                self.commit(base, [s for s in live if s.name not in gone] + made)
            finally:
                self._fs.delete(self._claim(folder), False)

    def _merged(self, merges: list[list[Shard]], folder: str) -> list[Shard]:
        """One file for each run, by one task that reads the run's shards: nothing is shuffled."""
        runs = [self._files(run).coalesce(1) for run in merges]
        return self._written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs), folder)

    def _files(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{s.name}" for s in shards])

    # ---- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's live shards, by default the last version's."""
        return self._files(self.shards(version))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes files that none of the last `keep` versions lists and no writer claims; returns their names.

        Files are listed before claims, and claims before versions: a file whose claim has gone by then is in a
        version, or its writer has failed.
        """
        found = {}
        files = self._fs.listFiles(self._path(f"{self.root}/shards"), True) if self._fs.exists(self._path(f"{self.root}/shards")) else None
        while files and files.hasNext():
            p = files.next().getPath()
            name = p.toString()[p.toString().rindex("/shards/") + 1 :]
            if name.endswith(".parquet"):
                found[name] = p
        oldest = (time.time() - CLAIM_SECONDS) * 1000
        claims = self._path(f"{self.root}/claims")
        claimed = {s.getPath().getName() for s in self._fs.listStatus(claims) if s.getModificationTime() >= oldest} if self._fs.exists(claims) else set()
        live = {s.name for v in self.versions()[-keep:] for s in self.shards(v)}
        gone = sorted(n for n in found if n not in live and n.split("/")[1] not in claimed)
        for n in gone:
            self._fs.delete(found[n], False)
        return gone


def sharded(spark: SparkSession, docs: DataFrame, arrivals: int = 4, target: int = TARGET_BYTES) -> DataFrame:
    """docs appended in arrivals, by a hash of doc_id, and compacted after each; read back from the live
    shards: doc_id, n_bytes, text_sha256. A null text has 0 bytes."""
    table = ShardedTable(spark, Workspace(spark, "sharding").at("table"), target)
    for k in range(arrivals):
        table.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
        table.compact()
        table.vacuum()
    if not table.shards():
        rows = docs.limit(0)
    else:
        rows = table.read()
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
