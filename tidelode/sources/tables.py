"""Sources: CSV, JSON lines and objects, folders of text files, unions, literal tables, configuration.

Schemas are explicit; a blank field is null. Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the workflow's files, in their order: fixed formats.
SCHEMAS = {
    "parse_summary": "file string, valid string, nsites int, formula string, error string",
    "labels": "file string, valid string, formula string, target string, hit_target string, error string",
    "ehull_scores": "file string, formula string, score_e_per_atom string, error string",
    "scores_failed": "file string, formula string, error_type string, error string, traceback string",
    "eval": "file string, valid string, formula string, target string, hit_target string, score_e_per_atom string, error string",
    "ehull_estimates": "file string, formula string, e_per_atom string, hull_ref_e_per_atom string, ehull_proxy string, ehull_method string",
    "composite_reward": "file string, formula string, e_per_atom string, r_proxy string, r_geom string, r_comp string, r_novel string, r_total string, gate_failed string, gate_reason string, percentile_proxy string, duplicate_flag string, min_interatomic_distance string, density string, mean_cn string, max_cn string",
    "pairs": "prompt string, target string, chosen string, rejected string, chosen_file string, rejected_file string, chosen_score double, rejected_score double, chosen_reward double, rejected_reward double, chosen_tokens int, rejected_tokens int, tag string",
    "sft_data": "file string, text string, token_ids array<int>, n_tokens int",
    "timing": "phase string, status string, timestamp bigint, timestamp_iso string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header, whose fields may hold quotes and line breaks. Columns are found by name, and those
    that a file lacks are null."""
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path)
    have = set(raw.columns)
    return raw.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; bad lines fail the query if strict, and are dropped otherwise. Blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_targets(spark: SparkSession, root: str, targets: Sequence[str], name: str, schema: str) -> DataFrame:
    """<root>/<target>/<name> of those targets that have it, with a column source_target. A target without
    rows leaves none."""
    found = [f"{root}/{t}/{name}" for t in targets if _exists(spark, f"{root}/{t}/{name}")]
    if not found:
        return spark.createDataFrame([], f"{schema}, source_target string")
    rows = read_jsonl(spark, found, schema, strict=False)
    parts = F.split(F.col("_metadata.file_path"), "/")
    depth = name.count("/") + 2
    return rows.withColumn("source_target", F.url_decode(F.element_at(parts, -depth)))


def read_structures(spark: SparkSession, folder: str, pattern: str = "*.cif", most: int | None = None) -> DataFrame:
    """Whole text files of a folder: file, text. With `most`, the first so many names."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows if most is None else rows.orderBy("file").limit(most)


def with_texts(rows: DataFrame, texts: DataFrame, key: str = "file") -> DataFrame:
    """Rows with the text of their file, by a join; a file that is missing gives null."""
    return rows.join(texts, key, "left")


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object as one row; a file that is missing gives a row of nulls."""
    if _exists(spark, path):
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.createDataFrame([(None,) * len(spark.createDataFrame([], schema).columns)], schema)


def read_sources(spark: SparkSession, tables: str | Sequence[str], folders: str | Sequence[str], schema: str) -> DataFrame:
    """Several CSV files with their folders, given as comma lists; one folder serves all files. Paths are
    checked before anything is read."""
    split = lambda v: [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) else list(v)
    tables, folders = split(tables), split(folders)
    if len(folders) == 1:
        folders *= len(tables)
    if len(tables) != len(folders):
        raise ValueError(f"{len(tables)} tables and {len(folders)} folders")
    missing = [p for p in (*tables, *folders) if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    out = None
    for t, f in zip(tables, folders, strict=True):
        one = read_csv(spark, t, schema).withColumn("cif_dir", F.lit(f))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def aligned(targets: Sequence[str], *lists: Sequence[str]) -> list[tuple[str, ...]]:
    """Each target with its entry of each list; a list that is short repeats its last one."""
    if any(not x for x in lists):
        raise ValueError("an empty list cannot be aligned")
    return [(t, *(x[min(k, len(x) - 1)] for x in lists)) for k, t in enumerate(targets)]


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that is there, as estimates before scores."""
    return next((p for p in paths if _exists(spark, p)), None)


def hull_table(spark: SparkSession, rows: Sequence[tuple[str, float]]) -> DataFrame:
    """Known hull energies by formula, the least of each. An empty list stands for a service that fails."""
    table = spark.createDataFrame(list(rows), "formula string, hull_energy double")
    return table.groupBy("formula").agg(F.min("hull_energy").alias("hull_energy"))


#: Defaults of the workflow's settings that queries use: fixed values.
DEFAULTS = {"TARGETS": "LiFePO4,NaCl,TiO2", "PROMPT_Z_MAP": "LiFePO4:4,NaCl:4,TiO2:2", "SEED": "42", "VAL_SPLIT": "0.1"}


def settings(environment: Mapping[str, str] | None = None, **over: str) -> dict[str, str]:
    """Settings from defaults, then the environment, then arguments."""
    env = os.environ if environment is None else environment
    return {k: over.get(k, env.get(k, v)) for k, v in DEFAULTS.items()}


def targets_of(config: Mapping[str, str]) -> list[str]:
    return [t.strip() for t in config["TARGETS"].split(",") if t.strip()]


def z_map(config: Mapping[str, str]) -> dict[str, int]:
    """Formula units by target."""
    pairs = [p.split(":") for p in config["PROMPT_Z_MAP"].split(",") if ":" in p]
    return {k.strip(): int(v) for k, v in pairs}


def branch_setting(config: Mapping[str, Mapping[str, str]], branch: str, name: str, default: str) -> str:
    """A setting of a branch, else the one for all, else the default. Blank values do not count."""
    return config.get(branch, {}).get(name) or config.get("", {}).get(name) or default


def str_to_map(text: Column) -> Column:
    """A 'key:value,...' text as a map column."""
    return F.str_to_map(text, F.lit(","), F.lit(":"))
