"""The corpus pipeline: from raw documents to the token ids of a training mix.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents:

1. language_id: rejected documents go, ``lang`` becomes the language found.
2. line_dedup: later repeats of runs of lines with 50 words or more are cut from the texts (``n_chars`` follows).
3. near_dedup: one document (the smallest id) of each SimHash group stays.
4. mixing: documents of each source are dropped, kept or doubled by the mix.
5. bpe: doc_id, lang, source, n_tokens, ids (binary, little-endian unsigned 32-bit), ids_sha256, decoded_sha256.

Null and empty texts are rejected by the first stage; each stage states its own cases in its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrieva.llm import bpe, language, lines, mixing, simhash
from retrieva.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.identify(docs, language.page_evidence(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)
    return simhash.one_of_each(docs, found).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    v = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.digests(bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), v), v))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode_bpe)]

#: Hashed trigram models, windows of lines and byte-pair merges aren't SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
