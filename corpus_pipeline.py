"""Corpus pipeline over ``documents``: quality rules, quality classifier, line
dedup, n-gram Jaccard join, best-fit packing.

Each stage reads what the one before kept, written as Parquet in the shared
folder; all but the last return the columns of documents.  Documents that the
rules or the classifier reject go; lines repeated across documents go from all
but the first; of each group of near duplicates the smallest doc_id stays; the
rest is packed into sequences, one row a piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ioclens.llm import jaccard_join, line_dedup, packing, quality_rules, site_classifier
from ioclens.llm.common import documents, stored, table

VOCABULARY = "word_bpe_49k.json"


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.stage(docs)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return site_classifier.stage(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.stage(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.query(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("best-fit packing", pack_sequences),
]
#: A fitted classifier and tokens cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is written and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
