"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, more columns and
clashing names included. An empty table gives an empty one.
SQL can't express the stages (a fitted ranker, fingerprints, a tokenizer); tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditweave.llm import decontaminate, exact_dedup, near, packing, quality
from auditweave.llm.common import mark, materialize, release, table
from auditweave.llm.queries import tokenizer

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below the threshold; labels of the held-out fold are not learned from.

    Null and empty texts are scored as empty, rows that repeat are judged each and alike, a score at the threshold stays. Without labels of
    both kinds nothing goes."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels"), cut=0.3))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts, that with the largest doc_id.

    A null text equals an empty one; a null id loses against any other; of rows that repeat one stays."""
    return exact_dedup.first_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near duplicates, that with the smallest doc_id: five-word shingles, similarity of 0.8 or more.

    Texts without words are a group; a text of fewer words than five is a shingle; a null id counts as the smallest; of rows that
    repeat one stays."""
    return near.one_of_each_group(docs, size=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ten words of a benchmark item, or a whole shorter item.

    Texts and items that are null or have no words hold nothing; rows that repeat are judged each and alike."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row for each piece.

    A null or empty text is the end id alone; rows that repeat and null ids are packed each."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), "words", capacity=2048, end=0)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since)  # all that went before is in docs now
    return STAGES[-1][1](spark, docs, sf_dir)
