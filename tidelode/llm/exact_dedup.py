"""Exact deduplication over a stream, with keyed state on disk.

Arrivals are read as a stream of records (digest, stable identifier, content locator). A streaming
aggregation keyed by the digest holds, for ever and in RocksDB, the identifier and locator of the row
that stays and the size of the group. Digests that were hit more than once are then checked on the
full bytes: their texts are read again and grouped by the bytes themselves, so that a collision of
digests splits the group instead of losing a text.

Defined cases: a null text counts as empty; texts that differ only in runs of white space are equal; of
equal rows the smallest identifier stays, null identifiers last, and of rows that repeat an identifier
the first written one; an empty table gives no rows; other columns are not read. Very long texts go through the
stream as digests; their bytes are read again only where a digest was hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm.workspace import Workspace, sized

#: Bytes of records in a micro-batch.
BATCH_BYTES = 512 << 20
#: Digests that one state store is meant for. Each store claims several MB on disk however little it
#: holds, so their number follows the arrivals and not the session's shuffle partitions.
STORE_DIGESTS = 2_000_000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: str = "text") -> F.Column:
    """The text with each run of white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(norm: F.Column, bits: int = 256) -> F.Column:
    """The first bits (whole bytes) of the SHA-256 of a text's UTF-8."""
    return F.substring(F.unhex(F.sha2(norm.cast("binary"), 256)), 1, bits // 8)


def _settled(spark: SparkSession, arrivals: DataFrame, work: Workspace, batch: dict, stores: int) -> DataFrame:
    """Runs the stateful stream over all arrivals; the last state of each digest."""
    settings = _STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(stores)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    reader = spark.readStream.schema(arrivals.schema)
    for k, v in batch.items():
        reader = reader.option(k, v)
    state = (
        reader.parquet(work.at("arrivals"))
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "file")).alias("keeper"), F.count("*").alias("group_size"))
    )

    def put(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(work.at(f"state/epoch={epoch}"))

    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", work.at("stream")).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    written = spark.read.schema("digest binary, keeper struct<no_id:boolean,id:bigint,row:bigint,file:string>, group_size bigint").option("recursiveFileLookup", "true").parquet(work.at("state"))
    # a digest is written again in each epoch that hits it; its keeper only falls and its size only grows
    return written.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size"))


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256, batch: dict | None = None, stores: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, keep_file.

    bits shortens the digest of the state (tests force collisions by it); batch holds options of the
    stream's file source, such as maxFilesPerTrigger; stores is the number of state stores, which a stream
    keeps for its life: by default one for each STORE_DIGESTS rows, and as many as tasks run at once.
    """
    work = Workspace(spark, "exact-dedup")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), normalised(text_col).alias("norm"), F.input_file_name().alias("file"))
    arrivals = work.write(docs.select("id", digest(F.col("norm"), bits).alias("digest"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "file", F.monotonically_increasing_id().alias("row")), "arrivals")
    rows = arrivals.count()
    if not rows:
        return _result(arrivals.withColumns({"keeper": F.struct(F.lit(False).alias("no_id"), "id", "row", "file"), "group_size": F.lit(1)}))
    stores = stores or max(spark.sparkContext.defaultParallelism, -(-rows // STORE_DIGESTS))
    hit = work.write(_settled(spark, arrivals, work, batch or {"maxBytesPerTrigger": BATCH_BYTES}, stores).where("group_size > 1"), "hit")
    # the full bytes of every hit text: equal ones meet in the map-side part of the aggregation
    texts = docs.withColumns({"digest": digest(F.col("norm"), bits), "row": F.monotonically_increasing_id()}).join(sized(hit.select("digest"), 64), "digest", "left_semi")
    variants = texts.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clashing = work.write(variants.groupBy("digest").agg(F.count("*").alias("variants")).where("variants > 1").select("digest"), "clashing")
    if clashing.isEmpty():
        return _result(arrivals.join(sized(hit, 160), "digest", "left"))
    # texts that share a digest are read again and grouped by their bytes
    apart = texts.join(sized(clashing, 64), "digest", "left_semi").withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    apart = work.write(apart, "apart")
    sole = apart.groupBy("digest", "norm").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "file")).alias("keeper"), F.count("*").alias("group_size"))
    rest = arrivals.join(sized(clashing, 64), "digest", "left_anti")
    return _result(rest.join(sized(hit, 160), "digest", "left").unionByName(apart.join(sole, ["digest", "norm"]).drop("norm")))


def _result(rows: DataFrame) -> DataFrame:
    one = F.coalesce(F.col("group_size"), F.lit(1)) == 1
    return rows.select(
        F.col("id").alias("doc_id"),
        F.when(one, F.col("id")).otherwise(F.col("keeper.id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("bigint").alias("group_size"),
        (one | (F.col("row") == F.col("keeper.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.when(one, F.col("file")).otherwise(F.col("keeper.file")).alias("keep_file"),
    )


def without_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops.

    Rows are told apart by doc_id; where a doc_id repeats, one row of each of its texts that stay is left.
    """
    work = Workspace(spark, "exact-dedup-rows")
    found = work.write(exact_dedup(spark, docs), "found")
    same = "(doc_id <=> keep_id)"
    gone = work.write(found.where(f"not {same}").select("doc_id", F.unhex("text_sha256").alias("sha")).distinct(), "gone")
    repeated = work.write(found.where(f"not kept and {same}").select("doc_id", F.unhex("text_sha256").alias("sha")).distinct(), "repeated")
    if repeated.isEmpty() and not found.where("doc_id is null").head(1):
        unclear = gone.select("doc_id").join(found.where("kept").select("doc_id"), "doc_id", "left_semi")
        if unclear.isEmpty():
            return docs.join(sized(gone.select("doc_id"), 24), "doc_id", "left_anti")
    keyed = docs.withColumn("sha__", F.unhex(F.sha2(normalised().cast("binary"), 256)))
    dropped = gone.select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    kept = keyed.join(dropped, keyed.doc_id.eqNullSafe(dropped.gone_id) & (keyed.sha__ == dropped.gone_sha), "left_anti")
    return kept.dropDuplicates(["doc_id", "sha__"]).drop("sha__")
