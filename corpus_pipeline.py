"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir); docs are the rows that the stage before
has kept, read back from Parquet. All stages but the last return the columns of
documents; the last returns one row per document of the token files.

A stage's result is to be written before the next stage is called: that discards
what the one before has staged, so that disk holds one stage's tables at a time.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, near_copies, quality_rules, simhash_dedup, token_files  # noqa: F401 (tests take the operators from here)
from quern.llm._store import written
from quern.sources import staging

_USED: dict[str, list[str]] = {}


def _stage(f):
    """The function, which first discards the tables that the stage before has staged, and remembers its own."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        staging.discard(spark, _USED.pop(app, []))
        before = set(staging.staged(spark))
        out = f(spark, docs, sf_dir)
        _USED[app] = [p for p in staging.staged(spark) if p not in before]
        return out

    return stage


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or a certified rule rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs.select(*COLUMNS), labels).where("verdict.kept").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of those left, likewise one of each group of near copies."""
    return near_copies.firsts_without_near_copies(docs.select(*COLUMNS))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; cuts the passage out of those that hold a single item."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the balanced sample does."""
    return mixing.mixed(docs.select(*COLUMNS))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files, and returns what they hold of each document."""
    return token_files.read_token_files(token_files.write_token_files(docs, token_files.tokenizer_path()))


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_files", tokens),
]

#: Hashes of shingles, the balanced sample and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has read goes when its result is written; the token files stay."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        staging.discard(spark, last)
        last = staging.staged(spark)[-1:]
    return docs
