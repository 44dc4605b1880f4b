"""The operators applied to their whole sample tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, embedding_links, html_text, licences, mixing, negatives, near_copies, repeats, token_counts, token_files, toxicity, transcripts
from .common import table, work_path

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix_sources(table(spark, sf_dir, "documents")))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; the files are on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcripts.format_conversations(table(spark, sf_dir, "conversations"))
    return turns.select(
        "conv_id", "turn", "piece", "role", "n_lines", "n_right",
        transcripts.rendered(F.col("role"), F.col("text")).alias("rendered"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "op5-files")
    token_files.encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), path)
    return token_files.read_token_files(spark, path, with_ids=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.masked_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.link_embeddings(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan_licences(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.digest(decontamination.decontaminate(docs, items))


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity half of op9 over whole tables: per document, windows whose two rarest terms
    stand within 20 words, and how many of those stand as in the window."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    near = decontamination.proximity_matches(docs, items)
    return near.groupBy("doc_id").agg(
        F.count("*").alias("n_near"), F.count_if("exact").alias("n_in_order"), F.min("nearest").alias("nearest")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op9_proximity": op9_proximity,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_html_extraction": op13_html_extraction,
}
