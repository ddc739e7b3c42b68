"""The corpus pipeline: documents through five operators, each working on what the one before it kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs. All but the last return the columns of documents.

Defined cases, for every stage: a null text counts as empty, and is kept where an empty one is; very long texts are read
whole by one task at a time; of rows that tie (equal texts, components) the smallest doc_id stays, null ones last;
rows that repeat count one by one, and copies go with exact_dedup; an empty table stays empty, without labels nothing
is rejected for its text, without a benchmark nothing is contaminated; further columns of documents are passed on as
they are, whatever their names, and the last stage returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm.decontaminate import clean_documents
from tidelode.llm.exact_dedup import without_copies
from tidelode.llm.ngram_join import one_of_each
from tidelode.llm.piece_lattice import segmented
from tidelode.llm.quality import good_documents
from tidelode.llm.queries import tokenizer_file
from tidelode.llm.workspace import Workspace
from tidelode.scratch import run_folders


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_documents(spark, docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_copies(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold passages of the benchmark."""
    return clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentation: doc_id, n_tokens, score, ids_sha256, exact, best."""
    return segmented(spark, docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL cannot express the classifier or the segmentation; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. What a stage's operators and the stage before it left is deleted when it is written."""
    work, before = Workspace(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with run_folders():
            docs = work.write(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
