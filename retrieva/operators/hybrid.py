"""Score fusion.

Variant 1 (A7/W3): dense top-k and *all* sparse hits, sparse scaled by its
per-query maximum, combined ``alpha * dense + (1 - alpha) * sparse / max``
with a missing side counting 0, then top-k.

Variant 2 (A8/W5): dense hits weighted ``alpha / (1 + distance)``, every
sparse hit adds a flat ``1 - alpha``; hits are keyed by content, so documents
with identical text merge into one entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import inverse_distance
from ..session import sent_if_small
from .topk import ranked_score, top_k


def _sent(df: DataFrame, name: str) -> DataFrame:
    """``df`` written; a join sends it to the tasks if it is small, so that the other side, hits of all documents or their texts, doesn't move."""
    df, few = sent_if_small(df, name)
    return F.broadcast(df) if few else df


def fuse_scores(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5) -> DataFrame:
    """A7 + J3: (query_id, doc_id, combined_score, dense_score, sparse_score).

    The per-query sparse maximum is a grouped aggregate (one row per query,
    partial aggregation before the shuffle), joined back on query_id; hits that
    went through ``cut_sparse`` bring it along as ``__max``."""
    if "__max" not in sparse.columns:
        mx = sparse.groupBy("query_id").agg(F.max("score").alias("__max"))
        sparse = sparse.join(mx, "query_id")
    s = (sparse.select("query_id", "doc_id", F.col("score").alias("sparse_score"),
                       (F.col("score") / F.coalesce(F.nullif(F.col("__max"), F.lit(0.0)), F.lit(1.0))).alias("__sn")))
    d = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"))
    j = d.join(s, ["query_id", "doc_id"], "full_outer")
    comb = (F.lit(alpha) * F.coalesce(F.col("dense_score"), F.lit(0.0))
            + F.lit(1.0 - alpha) * F.coalesce(F.col("__sn"), F.lit(0.0)))
    return j.select("query_id", "doc_id", comb.alias("combined_score"), "dense_score", "sparse_score")


def cut_sparse(dense_topk: DataFrame, sparse_hits: DataFrame, k: int, alpha: float) -> DataFrame:
    """The sparse hits that can matter for the fused top-k; the result stays exact.

    A document outside the dense top-k is ranked by its sparse score alone, so of these only the first k under the
    final ordering can get in; those in the dense top-k all stay, and with them each query's maximum, for the scaling.
    The cut is a limit in each window, applied before the shuffle, so the hits of all documents aren't sorted or joined."""
    mx = _sent(sparse_hits.groupBy("query_id").agg(F.max("score").alias("__max")), "sparse-maxima")
    d = _sent(dense_topk.select("query_id", "doc_id", F.lit(True).alias("__dense")), "dense-hits")
    s = sparse_hits.join(mx, "query_id").join(d, ["query_id", "doc_id"], "left")
    final = F.lit(1.0 - alpha) * (F.col("score") / F.coalesce(F.nullif(F.col("__max"), F.lit(0.0)), F.lit(1.0)))
    s = s.withColumn("__key", ranked_score(final)).withColumn("__dense", F.coalesce("__dense", F.lit(False)))
    w = Window.partitionBy("query_id", "__dense").orderBy(F.desc("__key"), F.asc("doc_id"))
    s = s.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    return s.select("query_id", "doc_id", "score", "__max")


def hybrid_top_k(dense_topk: DataFrame, sparse_hits: DataFrame, k: int = 5, alpha: float = 0.5,
                 docs: DataFrame | Callable[[DataFrame | None], DataFrame] | None = None) -> DataFrame:
    """W3 (+ J4): fused top-k with ties by doc_id; metadata attached after the cut. ``docs`` may be a function of the hits' ids, if they are few (counted;
    else of None), which makes the metadata of these documents only."""
    fused = fuse_scores(dense_topk, cut_sparse(dense_topk, sparse_hits, k, alpha), alpha)
    ranked = top_k(fused, "query_id", [F.desc(ranked_score("combined_score")), F.asc("doc_id")], k)
    if docs is not None:
        ranked, few = sent_if_small(ranked, "hybrid-hits")
        if callable(docs):
            docs = docs(F.broadcast(ranked.select("doc_id").distinct()) if few else None)
        ranked = (F.broadcast(ranked) if few else ranked).join(docs, "doc_id")
    return ranked


def fuse_by_content(dense_l2: DataFrame, bm25_top: DataFrame, docs: DataFrame, alpha: float = 0.5,
                    content_col: str = "text") -> DataFrame:
    """A8 + A14: variant-2 fusion keyed by the hit's text.

    dense_l2: (query_id, doc_id, score = squared L2 distance); bm25_top:
    (query_id, doc_id, ...). Documents with identical text share one key
    (``md5`` of the text) and the smallest doc_id represents it.
    Output (query_id, doc_id, content_key, fused_score)."""
    keyed = docs.select("doc_id", F.md5(F.col(content_col)).alias("content_key"))
    d = (_sent(dense_l2, "dense-hits").join(keyed, "doc_id")
                 .groupBy("query_id", "content_key")
                 # dense hits arrive best first and a later equal text overwrites
                 # an earlier one, so the weakest dense score of a text stands
                 .agg(F.min(F.lit(alpha) * inverse_distance("score")).alias("__d"), F.min("doc_id").alias("__d_id")))
    # every sparse hit adds (1 - alpha), also a second hit with the same text
    s = (_sent(bm25_top, "bm25-hits").join(keyed, "doc_id")
                 .groupBy("query_id", "content_key")
                 .agg(F.min("doc_id").alias("__s_id"), (F.count(F.lit(1)) * (1.0 - alpha)).alias("__s")))
    j = d.join(s, ["query_id", "content_key"], "full_outer")
    return j.select("query_id", F.least("__d_id", "__s_id").alias("doc_id"), "content_key",
                    (F.coalesce("__d", F.lit(0.0)) + F.coalesce("__s", F.lit(0.0))).alias("fused_score"))


def order_fused(fused: DataFrame, order: str = "desc") -> DataFrame:
    """Rank fused entries; ``order='asc'`` reproduces worst-first ordering.

    A query has at most (dense k + sparse n) entries, so a plain window suffices."""
    o = F.desc(ranked_score("fused_score")) if order == "desc" else F.asc(ranked_score("fused_score"))
    w = Window.partitionBy("query_id").orderBy(o, F.asc("doc_id"))
    return fused.withColumn("rank", F.row_number().over(w).cast("bigint"))
