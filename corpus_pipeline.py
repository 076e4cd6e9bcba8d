"""Corpus pipeline: the documents through the stages below, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfoundry.llm import jaccard_join, mixing, pieces, quality_rules, surrogates
from docfoundry.llm.common import materialise, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: with too few words or too many repeated ones, or a low score; so null and empty texts go.

    Null ids and repeated rows stay if their texts do; an empty table stays empty. All columns stay.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, with all its columns.

    Repeated rows are near copies; rows that share an id with unlike texts stay, as do null ids, and texts without words; an empty table
    stays empty.
    """
    return jaccard_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars counts the new text. Every row stays, in an empty table none; null texts stay null."""
    return surrogates.replace_in(docs)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says, so that languages get their target shares of tokens; ids repeat from here on.

    A null or empty text has no tokens and is rated like any other, as is a null id; an empty table stays empty.
    """
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return mixing.apply_mix(docs, labelled.select("doc_id", F.col("lang").alias("domain")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them, one row for each row; a null or empty text has no
    ids. Texts are taken whole in all stages, however long."""
    return pieces.digests(docs, with_ids=True)


STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", weights),
    ("SentencePiece encoding and decoding", encoded),
]
ORACLE_SQL = None  # the stages rest on trained models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline")
    return docs
