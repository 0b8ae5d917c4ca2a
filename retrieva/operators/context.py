"""Context assembly and prompts.

Every query has a handful of hits (k), so the per-query windows and ordered
aggregates here handle bounded groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PROMPT_V1, PROMPT_V2, chat_request, prompt

MISSING_TEXT = "[Could not load document]"


def attach_sources(hits: DataFrame, sources: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", missing: str = MISSING_TEXT) -> DataFrame:
    """Hits (left) joined to the source texts; a missing source reads as ``missing``."""
    s = sources.select(F.col(id_col), F.col(text_col).alias("__src"))
    return hits.join(s, id_col, "left").withColumn("source_text", F.coalesce("__src", F.lit(missing))).drop("__src")


def titled_context(hits: DataFrame, title_col: str = "title", text_col: str = "source_text",
                   rank_col: str = "rank") -> DataFrame:
    """Per query, '\\n\\n' + title + ':\\n' + text for each hit in rank order."""
    piece = F.concat(F.lit("\n\n"), F.col(title_col), F.lit(":\n"), F.col(text_col))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(rank_col).alias("r"), piece.alias("p")))),
        lambda x: x["p"]), "").alias("context"))


def pack_context(ranked: DataFrame, text_col: str = "text", rank_col: str = "rank",
                 limit: int = 3000, sep: str = "\n\n") -> DataFrame:
    """In rank order add a text (plus separator) while context length +
    text length < limit; stop at the first that does not fit.

    The running total before a row includes every earlier row, also one that
    did not fit, so once a row fails all later rows fail: a filter equals the
    loop's ``break``. Output (query_id, context, n_docs)."""
    w = Window.partitionBy("query_id").orderBy(rank_col).rowsBetween(Window.unboundedPreceding, -1)
    pre = F.coalesce(F.sum(F.length(text_col) + len(sep)).over(w), F.lit(0))
    fits = F.col("__pre") + F.length(text_col) < limit
    piece = F.when(fits, F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t")))  # null: not collected
    return ranked.withColumn("__pre", pre).groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: F.concat(x["t"], F.lit(sep))), "").alias("context"),
        F.count_if(fits).alias("n_docs"))


def with_prompt(df: DataFrame, context_col: str = "context", question_col: str = "question",
                variant: int = 1) -> DataFrame:
    """The prompt text (variant 1: answering job, variant 2: packed context)."""
    tpl = PROMPT_V1 if variant == 1 else PROMPT_V2
    return df.withColumn("prompt", prompt(context_col, question_col, tpl))


def with_request(df: DataFrame, prompt_col: str = "prompt", **kw) -> DataFrame:
    """The chat request body (system + user message) as JSON."""
    return df.withColumn("request", chat_request(prompt_col, **kw))
