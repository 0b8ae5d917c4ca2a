"""Bind the driver's test tables to the engine's roles (corpus, questions,
vectors, answer/reference pairs, pages, table rows, source paths).

Every reader names its columns, so Parquet scans read only what is used.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_not_blank, prefixed_content, title_of, word_count
from ..operators.corpus import irregular_nouns
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def corpus(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """S1 + P2-P5 over ``documents``: the file name is ``<source>_<doc_id>``. ``only`` (doc_id): the rows of these documents.

    Output (doc_id, name, content, source, length, title)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    d = spread(d) if only is None else d.join(only, "doc_id", "left_semi")
    named = d.filter(is_not_blank("text")).withColumn(
        "name", F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")))
    c = named.select("doc_id", "name", prefixed_content("name", "text").alias("content"), "source")
    return c.select("doc_id", "name", "content", "source",
                    word_count("content").alias("length"), title_of("content").alias("title"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: ``benchmark`` (query_id, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document vectors: ``embeddings`` with vec_id = doc_id (corpus documents only)."""
    docs = table(spark, sf_dir, "documents").filter(is_not_blank("text")).select("doc_id")
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dvec"))
    return e.join(docs, "doc_id", "left_semi")


def query_vectors(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Question vectors: ``embeddings`` with vec_id = item_id (or of the questions ``asked``)."""
    q = (questions(spark, sf_dir) if asked is None else asked).select("query_id")
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return e.join(q, "query_id", "left_semi")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer/reference pairs: a user turn and the assistant turn right after it.

    Output (conv_id, turn, reference, answer): reference = user text,
    answer (hypothesis) = assistant text."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def pages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: ``conversations`` with conv_id = document and turn = page number."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def table_rows(spark: SparkSession, sf_dir: str, pages: int = 1) -> DataFrame:
    """Extracted table rows: one table per customer and page from ``orders`` (dealt over ``pages`` by order key).

    Output (doc_id, page_no, row_no, cells ARRAY<STRING>). Each page holds the
    header row (row_no 0), data rows follow (row_no = order key + 1). Cells of
    orders in status 'P' (pending) are blank: an all-null row for the
    table operators to drop."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    blank = F.col("o_orderstatus") == "P"
    page = (F.col("o_orderkey") % pages).cast("int")
    cells = F.array(
        F.when(blank, F.lit(None)).otherwise(F.col("o_orderkey").cast("string")),
        F.when(blank, F.lit(None)).otherwise(F.col("o_orderstatus")),
        F.when(blank, F.lit(None)).otherwise(F.col("o_orderpriority")))
    data = o.select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("doc_id"),
                    page.alias("page_no"), (F.col("o_orderkey") + 1).alias("row_no"), cells.alias("cells"))
    header = (o.select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("doc_id"), page.alias("page_no")).distinct()
               .select("doc_id", "page_no", F.lit(0).cast("bigint").alias("row_no"),
                       F.array(F.lit("orderkey"), F.lit("status"), F.lit("priority")).alias("cells")))
    return header.unionByName(data)


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source paths: ``pages.url``."""
    return table(spark, sf_dir, "pages").select("page_id", "url")


def customers_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that own the tables: one per customer, id ``cust<key>``, text = name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.select(F.concat(F.lit("cust"), F.col("c_custkey").cast("string")).alias("doc_id"),
                    F.col("c_name").alias("text"))


def fallback_texts(spark: SparkSession, sf_dir: str, prefix: str = "cust") -> DataFrame:
    """Fallback (OCR-like) text per document: the page's HTML with tags blanked,
    page_id bound to the document id ``<prefix><page_id>``."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select(F.concat(F.lit(prefix), F.col("page_id").cast("string")).alias("doc_id"),
                    F.regexp_replace("html", "<[^>]*>", " ").alias("text"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon rows (form, lemma): the irregular nouns, and pairs of neighbouring words of ``benchmark`` (the words are invented, so any
    pair is as good a form and lemma as another; forms repeat, and some are their own lemma)."""
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    pairs = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(
        F.transform(F.sequence(F.lit(2), F.greatest(F.size("w"), F.lit(2))), lambda i: F.struct(F.get("w", i - 2).alias("form"), F.get("w", i - 1).alias("lemma")))).alias("x"))
    return pairs.select("x.form", "x.lemma").filter("form <> '' AND lemma <> ''").unionByName(irregular_nouns(spark))
