"""Queries that go through files: tables written by the sinks and read again by the sources, and what is counted of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelode.functions import expressions as E
from tidelode.operators import ranking, stats
from tidelode.plans.common import r6, table
from tidelode.scratch import Workspace
from tidelode.sources import sinks, tables
from tidelode.sources.named_files import write_named_files

#: Names of files that a bounded scan takes.
FIRST = 50


def _named(key: str = "doc_id") -> F.Column:
    return F.format_string("%08d.cif", key).alias("file")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a summary in CSV, texts with quotes and line breaks among its fields, read by name; in order of files."""
    work = Workspace(spark, "csv-scan")
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("error"), _named(), (F.col("n_chars") > 100).cast("string").alias("valid"), F.col("doc_id").cast("int").alias("nsites"))
    sinks.write_csv(docs, work.at("summary"), ["error", "nsites", "file", "valid"])
    rows = tables.read_csv(spark, work.at("summary"), tables.SCHEMAS["parse_summary"]).orderBy("file")
    return rows.select("file", "valid", "nsites", "formula", F.sha2("error", 256).alias("error_sha256"))


def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in a folder for each language, with lines that are no JSON among them, read by target."""
    work = Workspace(spark, "jsonl-scan")
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("lang", _named(), "text", F.col("n_chars").cast("int").alias("n_tokens"))
    targets = sorted(r.lang for r in docs.select("lang").distinct().collect())  # languages are a few
    for t in targets:
        sinks.write_jsonl(docs.where(F.col("lang") == t).drop("lang"), work.at(f"{t}/data"))
        spark.createDataFrame([("{not json",), ("",)], "value string").coalesce(1).write.mode("append").text(work.at(f"{t}/data"))
    rows = tables.read_jsonl(spark, [work.at(f"{t}/data") for t in targets], tables.SCHEMAS["sft_data"], strict=False)
    tagged = rows.withColumn("source_target", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))
    return tagged.where("file is not null").select("source_target", "file", "n_tokens", F.sha2("text", 256).alias("text_sha256"))


def folder_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the text of their file, absent for files that are not there, and whether a bounded scan takes it."""
    work = Workspace(spark, "folder-lookup")
    docs = table(spark, sf_dir, "documents").where("n_chars % 4 > 0").select(_named(), "text")
    write_named_files(docs.repartition(spark.sparkContext.defaultParallelism), work.at("cifs"), "file", "text")
    texts = tables.read_structures(spark, work.at("cifs"))
    first = tables.read_structures(spark, work.at("cifs"), most=FIRST).select("file", F.lit(True).alias("first"))
    rows = tables.with_texts(table(spark, sf_dir, "labels").select("doc_id", _named()), texts).join(first, "file", "left")
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.coalesce("first", F.lit(False)).alias("first"))


def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each extension, whatever its case, among paths made from pages."""
    kinds = F.array(*[F.lit(x) for x in ("png", "PNG", "jpg", "tar.gz", "")])
    kind = F.element_at(kinds, (F.length("html") % 5 + 1).cast("int"))
    paths = table(spark, sf_dir, "pages").select(F.concat(F.lit("out.d/p"), F.col("page_id"), F.when(kind == "", "").otherwise(F.concat(F.lit("."), kind))).alias("path"))
    return stats.extension_counts(paths)


def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as failures: type, cut message and cut trace, and the place of the type among all by how often it occurs."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ValueError", "KeyError", "TypeError", "OSError")]), (F.length("html") % 7 % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", E.failure_row(kind, F.col("html"), F.concat("url", "html")).alias("f")).select("page_id", "f.*")
    # a row a type: few, whatever the number of failures
    order = rows.groupBy("error_type").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "error_type")))
    return rows.join(F.broadcast(order), "error_type").select("page_id", "error_type", F.md5("error").alias("error"), F.md5("traceback").alias("traceback"), "n", "rank")


def legacy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pairs of an older layout: an energy under one of three names, and margins that may be no numbers."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 3 == 0, F.col("p_size").cast("string")).alias("chosen_energy"), F.when(k % 3 < 2, F.concat(F.lit(" "), F.col("p_size") + 100)).otherwise(" ").alias("chosen_ehull"),
        F.col("p_name").alias("chosen_score"), F.element_at(F.array(F.lit("1.5"), F.lit(""), F.lit("x"), F.lit(" -2e1 ")), (k % 4 + 1).cast("int")).alias("margin"),
    )
    return rows.select("p_partkey", E.first_of("chosen_energy", "chosen_ehull", "chosen_score").alias("energy"), r6(E.number_or_zero("margin"), "margin"))


def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's checkpoints, named by zero-padded steps, the last one."""
    name = F.format_string("step_%07d.pt", (F.col("event_id") * 7919 % 1_000_003))
    rows = table(spark, sf_dir, "events").select("user_id", name.alias("name"), F.concat(F.lit("ckpt/"), F.col("event_type"), F.lit("/"), name).alias("path"))
    return ranking.latest(rows, "user_id", "name", "path")


def top_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest brands of parts with count, share and place."""
    top = stats.fractions(table(spark, sf_dir, "part"), "p_brand").orderBy(F.desc("n"), "p_brand").limit(10)
    return top.select("p_brand", "n", r6("fraction"), F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")).alias("rank"))


QUERIES = {f.__name__: f for f in (csv_scan, jsonl_scan, folder_lookup, extension_counts, failure_rows, legacy_columns, latest_checkpoint, top_distribution)}

ORACLE_SQL = {
    "csv_scan": """
        select printf('%08d.cif', doc_id) as file, (n_chars > 100)::varchar as valid, doc_id::int as nsites, null::varchar as formula, sha256(nullif(text, '')) as error_sha256 from documents""",
    "jsonl_scan": "select lang as source_target, printf('%08d.cif', doc_id) as file, n_chars::int as n_tokens, sha256(text) as text_sha256 from documents where lang is not null",
    "folder_lookup": f"""
        with there as (select doc_id, text, row_number() over (order by printf('%08d.cif', doc_id)) as place from documents where n_chars % 4 > 0)
        select l.doc_id, sha256(text) as text_sha256, coalesce(place <= {FIRST}, false) as first from labels l left join there using (doc_id)""",
    "extension_counts": """
        select case length(html) % 5 when 2 then 'jpg' when 3 then 'gz' when 4 then '' else 'png' end as extension, count(*) as n from pages group by 1""",
    "failure_rows": """
        with f as (select page_id, (['ValueError', 'KeyError', 'TypeError', 'OSError'])[length(html) % 7 % 4 + 1] as error_type, md5(html[1:500]) as error, md5((url || html)[1:1000]) as traceback from pages),
        o as (select error_type, count(*) as n, (row_number() over (order by count(*) desc, error_type))::int as rank from f group by error_type)
        select page_id, error_type, error, traceback, n, rank from f join o using (error_type)""",
    "legacy_columns": """
        select p_partkey, case p_partkey % 3 when 0 then p_size::varchar when 1 then (p_size + 100)::varchar else p_name end as energy, (([1.5, 0, 0, -20])[p_partkey % 4 + 1])::double as margin from part""",
    "latest_checkpoint": """
        with r as (select user_id, printf('step_%07d.pt', event_id * 7919 % 1000003) as name, event_type from events)
        select user_id, arg_max('ckpt/' || event_type || '/' || name, name) as path from r group by user_id""",
    "top_distribution": """
        select p_brand, count(*) as n, round(count(*) / (select count(*) from part), 6) as fraction, (row_number() over (order by count(*) desc, p_brand))::int as rank
        from part group by p_brand order by n desc, p_brand limit 10""",
}
