"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, forest, language, lines, mixing, periodic, sharding, simhash, spelling, toxicity, urls, winnow
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(d, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    decided = language.identify(d, language.page_evidence(spark, sf_dir))
    keys = d.select("doc_id", F.col("lang").alias("declared"), F.xxhash64("text").alias("_h"))
    return language.with_languages(keys, decided, "doc_id", "_h").select("doc_id", "declared", "language", "confidence", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(d, v), v)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(d, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(page_id, url) with ``good``: the labels of the document whose id is the number in the url's path."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    p = p.withColumn("_doc", F.expr("try_cast(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1) AS bigint)"))
    good = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.min(F.col("quality") * (1 - F.col("toxic"))).cast("long").alias("good"))
    return p.join(good, "_doc", "left").drop("_doc")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(labelled_pages(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = winnow.against_next(table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow.digest("fp").alias("fingerprint"),
                    winnow.digest("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the control strings themselves."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    c = c.unionByName(spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], c.schema))
    template = chat.Template(chat.INSTRUCT, chat.CONTROLS)
    head, _, tail, _ = template.by_turn()
    turns = chat.read_back(chat.format_conversations(c, template))
    return chat.conversation_digests(turns, len(head) + len(tail))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.worn_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_language_id": op3_language_id, "op4_line_dedup": op4_line_dedup,
           "op5_bpe": op5_bpe, "op6_embedding_dedup": op6_embedding_dedup, "op7_toxicity": op7_toxicity, "op8_url_filters": op8_url_filters,
           "op9_mixing": op9_mixing, "op10_fingerprints": op10_fingerprints, "op11_chat": op11_chat, "op12_spelling": op12_spelling, "op13_periodic": op13_periodic}
#: Where SQL can't express an operator, tests/llm holds its query against brute force.
ORACLE = {"op6_embedding_dedup": forest.ORACLE_SQL, "op8_url_filters": urls.oracle_sql(), "op9_mixing": mixing.ORACLE_SQL}
