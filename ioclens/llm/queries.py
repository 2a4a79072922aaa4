"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, graph_ann, jaccard_join, line_dedup, packing, quality_rules, quote_links, site_classifier, spelling, token_align, token_counts, token_store, warc
from .common import documents, table

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.query(table(spark, sf_dir, "embeddings"))


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.query(table(spark, sf_dir, "conversations"))


def op3_warc_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.query(documents(spark, sf_dir))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.query(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(documents(spark, sf_dir))


def op8_site_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_classifier.query(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.query(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.query(documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.query(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_graph_ann, op2_quote_links, op3_warc_normalizer, op4_line_dedup, op5_jaccard_join, op6_token_store, op7_quality_rules, op8_site_classifier, op9_best_fit_packing,
                                  op10_bpe_transducer, op11_token_counts, op12_token_alignment, op13_spelling_variants)}
ORACLE = {"op2_quote_links": quote_links.SQL, "op3_warc_normalizer": warc.SQL, "op5_jaccard_join": jaccard_join.SQL, "op4_line_dedup": line_dedup.SQL, "op7_quality_rules": quality_rules.SQL,
          "op13_spelling_variants": spelling.SQL}
