"""Sinks: CSV, JSON lines and objects, routed and conditional output, reports, ranked files, markers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.sources.named_files import read_manifest, write_named_files


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and a fixed order of columns; null and empty are both written as nothing."""
    df.select(*columns).write.mode("overwrite").options(header=True, escape='"', nullValue="", emptyValue="").csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines in UTF-8, null fields included; appended for logs."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one piece, through the store's own API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_summary(row: DataFrame, path: str) -> dict:
    """A table of one row as an indented JSON object; returns it."""
    body = json.loads(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).head()[0])
    write_text(row.sparkSession, path, json.dumps(body, indent=2, ensure_ascii=False))
    return body


def write_routed(df: DataFrame, path: str, route: Column) -> None:
    """Rows into a folder for each value of a route, as valid and invalid structures."""
    df.withColumn("route", route).write.mode("overwrite").partitionBy("route").parquet(path)


def copy_routed(files: DataFrame, path: str, route: Column, content: str = "text") -> None:
    """Each row's file, by its name and with its bytes, into the folder of its route: valid_cifs and invalid_cifs."""
    write_named_files(files, path, "file", content, route)


def write_if_any(df: DataFrame, path: str, columns: Sequence[str]) -> bool:
    """Writes CSV only if there are rows; tells whether it did."""
    if df.isEmpty():
        return False
    write_csv(df, path, columns)
    return True


def export_ranked(top: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The texts of a top-k, one file a rank, written by tasks; top has target, phase, rank, file and text. Returns
    the manifest: the columns of top without the text, and where each file is."""
    name = F.format_string("%s_%s_%02d_%s", "target", "phase", "rank", "file")
    write_named_files(top.withColumn("__file", name), path, "__file", text)
    return read_manifest(top.sparkSession, path).withColumn("cif_path", F.concat(F.lit(f"{path}/"), "name"))


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    """A snapshot of the settings of a run."""
    write_text(spark, path, json.dumps(config, indent=2, sort_keys=True))


def log_event(spark: SparkSession, path: str, **fields) -> None:
    """Appends one record, with the time in milliseconds, to a folder of JSON lines."""
    row = spark.range(1).select(F.unix_millis(F.current_timestamp()).alias("timestamp"), *[F.lit(v).alias(k) for k, v in fields.items()])
    write_jsonl(row.coalesce(1), path, append=True)
