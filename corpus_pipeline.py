"""Five text stages over documents, each written as Parquet and read again by the next.

Quality rules drop what they reject; line dedup deletes later copies of line runs, and documents of
which nothing is left; the n-gram Jaccard join keeps one document of each near-duplicate group (five
words, similarity 0.8); mixing repeats or drops documents to reach the sources' target weights; the
last stage adds SentencePiece ids and their number. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelag.llm import jaccard_join, line_dedup, mixing, pieces, quality_rules
from tidelag.llm.common import stage


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def delete_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines; documents that consisted of such copies go."""
    return line_dedup.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, and all that are in none."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights ask for."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids and n_tokens; a null text has null ids and 0 tokens."""
    return pieces.with_token_ids(docs, pieces.Pieces.read())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", filter_quality),
    ("line_dedup", delete_copied_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Encoding can't be told in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole documents table; all but the last are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
