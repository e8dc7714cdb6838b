"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing to target weights, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of their input. Rows without an id pass the near-duplicate stage; rows that share an id are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakesift.llm import line_dedup, mixing, ngram_join, pieces, quality
from lakesift.llm.common import Scratch, growing, table

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
MODEL = "piece_bpe_32k.model"


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that fail a rule are taken out of those that stay."""
    return quality.filter_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near copies stays; documents without a line left go."""
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents stays."""
    linked = ngram_join.link(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    others = growing(linked.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.draw_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens and whether they decode to the text again."""
    return pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the encoding; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
