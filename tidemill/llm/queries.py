"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, lengths, lines, linkrank, media, mixing, quality, simhash, tokens
from .work import table, written


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_digests(table(spark, sf_dir, "documents"))


def op2_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op4_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op5_url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge_urls(table(spark, sf_dir, "pages"))


def op6_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op9_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the histogram is small beside the texts: written once, so that its sums don't encode them again
    return lengths.suffix_sums(written(lengths.length_histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents")))))


def op10_benchmark_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def rgb_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors of op1's images, stored and read back."""
    return media.tensor_digests(table(spark, sf_dir, "documents"))


def linked_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's ranks where hosts link to each other, as the pages of the tables don't: by links derived from page numbers."""
    return linkrank.linked_hosts(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_media_jpeg": op1_media_jpeg,
    "op2_token_rans": op2_token_rans,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_svm": op4_language_svm,
    "op5_url_links": op5_url_links,
    "op6_simhash_covering": op6_simhash_covering,
    "op7_quality_subword": op7_quality_subword,
    "op8_mix_pivotal": op8_mix_pivotal,
    "op9_token_histogram": op9_token_histogram,
    "op10_benchmark_minhash": op10_benchmark_minhash,
    "rgb_tensors": rgb_tensors,
    "linked_hosts": linked_hosts,
}
ORACLES: dict[str, str] = {"op3_line_dedup": lines.ORACLE, "op5_url_links": linkrank.oracle(), "op10_benchmark_minhash": decontam.ORACLE, "linked_hosts": linkrank.linked_oracle()}
