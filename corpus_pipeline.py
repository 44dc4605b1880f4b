"""The training-data pipeline: toxicity, near-dedup, decontamination, source mix, token files.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.
Its result is written as Parquet to the shared folder and read again as the next one's docs,
so a lost executor or driver costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm import decontamination, mixing, near_copies, token_files, toxicity
from ledgermill.llm.common import small_batches, table, work_path
from ledgermill.llm.queries import WORD_TOKENIZER, tokenizer_path

# Workers outlive a stage, so the last one's store takes room from the others.
KEPT_PIECES = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. It is fitted on all labels of ``docs``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id."""
    small_batches(spark)
    return near_copies.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source mix takes it, which may be never."""
    return mixing.take_copies(docs, mixing.mix_sources(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mix, read back: one row per document with its place in them."""
    small_batches(spark)
    path = work_path(spark, "pipeline-tokens")
    token_files.encode_to_files(docs, tokenizer_path(WORD_TOKENIZER), path, kept=KEPT_PIECES)
    return token_files.read_token_files(spark, path, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_to_weights),
    ("token_files", write_tokens),
]

# The stages fit models, search by hashes and code files: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
