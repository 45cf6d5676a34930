"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.ann import search
from gridloom.llm.base import read, split_of
from gridloom.llm.html_extract import extract
from gridloom.llm.jaccard import jaccard_components
from gridloom.llm.language_id import identify, train
from gridloom.llm.media import media_features, with_media
from gridloom.llm.mixing import mixed, word_count
from gridloom.llm import bpe, licenses, toxicity
from gridloom.llm.suffix_dedup import WORDS_51, repeat_report


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, split_of("doc_id", 3) != 1)
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), (split_of("id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return media_features(with_media(docs)).withColumnRenamed("id", "doc_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"), F.col("_mix.weight").alias("weight"), F.col("_mix.block").alias("block"), F.col("_mix.copies").alias("copies"), F.col("_mix.slot").alias("slot"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(docs, vocabulary).withColumnRenamed("id", "doc_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), lambda i: split_of(i, 4) != 2)
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (split_of("id", 4) == 2).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeat_report(docs, words=WORDS_51).withColumnRenamed("id", "doc_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_media_columns": op2_media_columns,
    "op3_mix_sources": op3_mix_sources,
    "op4_bpe": op4_bpe,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scan": op9_license_scan,
    "op10_nearest_vectors": op10_nearest_vectors,
}

ORACLE_SQL: dict[str, str] = {}
