"""A corpus from raw documents to token ids: language, near copies, repeated passages, source mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.  Extra columns of any name keep
their values up to the last stage; empty tables give empty tables, repeated rows are treated alike or as copies of each
other, and texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, langid, mixing, paragraphs, simhash
from maskwright.llm.common import fresh, setup
from maskwright.session import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without a letter and undecided ones go, whatever their id."""
    setup(spark)
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; rows without a word are copies of each other."""
    setup(spark)
    return simhash.simhash_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that several documents share stay in the first of them only; every row stays, null texts too."""
    setup(spark)
    return paragraphs.remove_passages(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources (null is one) have their target weights, in a random order."""
    setup(spark)
    return mixing.mix(docs, added=fresh(docs.columns, "n_copies", "copy", "order_key")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, four bytes each) of every text, and the checksum of what they decode to; a null text has none."""
    setup(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.bpe_round_trip(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("passages", passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Several stages (trained models, components of a graph of sampled hashes) have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage gives is written and read again."""
    setup(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
