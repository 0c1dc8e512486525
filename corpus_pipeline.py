"""The corpus pipeline: language ID, n-gram Jaccard join, secret scans, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame in the columns of documents; the last returns pieces. Any column may
be null; equal rows are rows of their own except in the n-gram join; texts of any length are read whole; further columns go along
through all stages but the last, whatever their names (those beginning with two underscores are the operators' own); an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm import language, mixing, ngram_join, packing, secrets
from maskframe.llm.common import stored, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (also null and empty texts) or without a likely language go; all other rows stay as they are."""
    return language.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays, of equal rows one. Texts without words are
    linked with nothing; rows without an id come last."""
    return ngram_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark and n_chars follows; no row goes, null texts stay null."""
    return secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is one of its own; texts without words are never taken."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is one piece with the end mark."""
    return packing.pack(docs, str(packing.default_tokenizer()), digest=True)


STAGES = [
    ("language ID", known_languages),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("source mixing", mixture),
    ("packing", packed),
]

#: Trained models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs, f"stage{k}") if k < len(STAGES) - 1 else docs
    return docs
