"""Corpus pipeline over ``documents``: quality rules, quality classifier, exact and near deduplication, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. What holds for all of them: extra columns pass
through unchanged, whatever their names are; texts of any length are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules, queries
from tessera.llm._common import configure, materialize, purge_scratch, scratch_mark


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host does, go. Null and empty texts have no words and go; a null or
    blank source is no host, so only the base rules judge it; null ids, languages and counts don't matter; repeated rows
    share a verdict and all count for their host."""
    configure(spark)
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go; it learns from ``labels`` of documents that came this far, in the
    folds that ``op10`` learns from. Null and empty texts have the score of a text without words; rows with a null id are
    scored but never learned from; a repeated id is learned from once, with its smallest label; without any label all
    scores are the same and at least 0.3, so all stay."""
    configure(spark)
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; null and empty texts are equal. Rows that repeat id and text stay
    together; null ids are larger than all others, and a group without any other id stays whole."""
    configure(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word Jaccard similarity of 0.8 or more) the one with the smallest id stays. Texts without
    words, null ones too, are alike; rows with null ids stay and link nothing; rows of one id stay together."""
    configure(spark)
    return near_dedup.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their places in sequences of at most 1024 ids. Null and empty texts are the end id
    alone; rows with null or repeated ids are packed like others; other columns of the documents end here."""
    configure(spark)
    return packing.pack_documents(docs, queries.byte_bpe_path())


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("exact_dedup", exact), ("simhash", near), ("best_fit_packing", pack)]

#: Learned scores, fingerprints and tokens are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written before the next reads it. Tables that the result doesn't read are
    deleted before it is returned."""
    mark = scratch_mark()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    purge_scratch(spark, mark, out)
    return out
