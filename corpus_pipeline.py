"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, masking of personal
data and mixing. ``STAGES`` holds its stages, functions of (spark, docs, sf_dir); each is written as Parquet and read again by
the next, which therefore begins by deleting the intermediate tables of the stages before. All stages but the last return the columns of documents; the last returns the mix, a row for each time that a document is
taken. A stage works on every row that the one before kept, whatever its columns hold; see each operator's docstring for null, empty and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import decontam, mixing, neardup, pii, quality
from stratum.scratch import Scratch, release


#: Labels of the stages' intermediate tables, in order.
LABELS = ["pipeline-quality", "pipeline-neardup", "pipeline-decontam", "pipeline-pii", "pipeline-mix"]


def _begin(spark: SparkSession, k: int) -> str:
    """The label of stage ``k``; what the stages before it have left goes. Batches for Python hold a bounded number of bytes."""
    release(spark, set(LABELS[:k]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return LABELS[k]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, _begin(spark, 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each group the document with the smallest id stays."""
    return neardup.deduplicate(docs, neardup.Near(words=5, percent=80), _begin(spark, 1))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), label=_begin(spark, 2))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, _begin(spark, 3))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, label=_begin(spark, 4))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("personal_data", personal_data_masked), ("mix", mixed)]

#: Sketches, similarity components and the bootstrap have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
