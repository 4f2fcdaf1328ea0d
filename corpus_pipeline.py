"""A corpus pipeline of the operators in tidemill.llm: good documents, each once, no test items, mixed, as token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, mixing, nearsets, quality, tokens
from tidemill.llm.work import kept, swept, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op7, learned from the labelled ones, rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by shingles of five words and a similarity of 0.8, the smallest doc_id stays."""
    return nearsets.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a test item's shingles of five words go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and each document's place and checksum as read back from them.

    The files are kept: under the folder that ``spark.tidemill.tokens.dir`` names, which must be new, else in the shared
    folder under a name that ``spark.tidemill.tokens.made`` has afterwards.
    """
    path = spark.conf.get("spark.tidemill.tokens.dir", None)
    if not path:
        path = kept(spark)
        spark.conf.set("spark.tidemill.tokens.made", path)
    return tokens.token_index(docs, path)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
    ("token output", token_output),
]

#: Learned scores, approximate links, dependent rounding and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is written and read by the next, and what a stage needs besides goes with it.

    Null, empty and very long texts, repeated rows, null ids and further columns pass through every stage as its operator
    states. An empty table gives no rows and empty token files.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with swept(spark):
            docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
