"""Stages of a training-data pipeline; run() applies them in order to documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, toxicity
from gridloom.llm.base import cut, read, split_of
from gridloom.llm.jaccard import JaccardParams, one_of_each
from gridloom.llm.mixing import mixed, repeat_rows
from gridloom.llm.suffix_dedup import WORDS_51, without_repeats

#: Near copies share four fifths of their five-word shingles; op5 has thresholds of its own.
NEAR = JaccardParams(size=5, low=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go; labels of split 2 stay unseen."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), lambda i: split_of(i, 4) != 2)
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return one_of_each(docs, params=NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of over 50 words, or of 400 bytes, leave the texts; every document stays."""
    return without_repeats(docs, words=WORDS_51)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as their source's weight asks; the budget passes over each at least once."""
    return repeat_rows(mixed(docs), docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of the text they decode to."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(docs, vocabulary, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Trained weights, components and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
