"""Mixing sources to target weights: nested hash thresholds found from histograms.

Every document has a fixed hash of its id and text. A source that is to give ``r`` times its size gives every document
``floor(r)`` times and, once more, the documents whose hash is below a threshold. The threshold comes from sums of
sizes by (source, hash bucket): walk the buckets up to the budget, then refine *only the boundary bucket* by the next
hash bits, until it holds one hash value. So nothing is sorted, thresholds for larger budgets contain those for
smaller ones (a nested family), and reruns agree.

Cases: null text has size 0; a null source is a source of its own, ordered last; rows equal in id and text share a hash and
are taken or left together; rows without an id, or with one id, are told apart by their texts; an empty table gives an empty result; a source
without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrieva.session import materialize

from .common import broadcast_if_small, n_words

#: The hash has 60 bits (15 hex digits of MD5), read in levels of 12: 4,096 buckets for a source at a level.
HASH_BITS, LEVEL_BITS = 60, 12


def row_hash(id_col: str, text_col: str) -> Column:
    """Hash of id and text, so that rows without an id, or with one id, are told apart (rows equal in both are taken alike)."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of every source: ``share`` times all sizes, dealt by weight, no source above ``most`` times its size.

    sizes(source, source_size), one row per source. Weights repeat over the sources in code-point order, null last.
    Resharing the excess by weight until no source is above its cap ends at one water level ``l`` with
    target = min(cap, l * weight): taken in the order of cap / weight, a source is capped while what is left,
    dealt by weight over it and the later ones, still covers its cap. Sources are few (one row each), so these windows are small.
    """
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
    level = (F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Hash threshold of every source: the documents with a smaller hash have sizes that sum to near ``budget``.

    sized(source, size, hash), budgets(source, budget). The sum is off by less than the documents of one hash value;
    of the two sides, the nearer is taken. Output (source, below).
    """
    done = None
    # open buckets: hash prefix ``at`` of ``used`` bits, ``before`` = sizes below it
    edge = budgets.filter("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("at"), F.lit(0).cast("double").alias("before"))
    for used in range(0, HASH_BITS, LEVEL_BITS):
        left = HASH_BITS - used
        e = broadcast_if_small(edge.select(F.col("source").alias("_s"), "budget", "at", "before"))
        inside = sized.join(e, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", left) == F.col("at")))
        # sums by bucket, made before the shuffle as well
        hist = inside.groupBy("source", F.shiftright("hash", left - LEVEL_BITS).alias("bucket")).agg(
            F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.first("budget").alias("budget"), F.first("before").alias("base"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.col("base") + F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
        last = materialize(hist.filter((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("upto")))
                           .select("source", "budget", F.col("bucket").alias("at"), "before", "upto", "lo", "hi"), "mix-edge")
        single = (F.col("lo") == F.col("hi")) if used + LEVEL_BITS < HASH_BITS else F.lit(True)
        found = last.filter(single).select("source", F.when(F.col("upto") - F.col("budget") < F.col("budget") - F.col("before"), F.col("hi") + 1).otherwise(F.col("lo")).alias("below"))
        done = found if done is None else done.unionByName(found)
        edge = last.filter(~single).select("source", "budget", "at", "before")
        if edge.isEmpty():
            break
    return done


def plan(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized(source, size, hash), written -> one row for each source: (_s, source_size, target, passes, below)."""
    p = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    p = p.withColumn("passes", whole).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    below = thresholds(sized.select("source", "size", "hash"), p.select("source", "budget"))
    return materialize(p.join(below.select(F.col("source").alias("_b"), "below"), F.col("source").eqNullSafe(F.col("_b")), "left")
                       .select(F.col("source").alias("__mx_s"), "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below")), "mix-plan")


def times(docs: DataFrame, planned: DataFrame, hashed: Column, source_col: str = "source") -> DataFrame:
    """``docs``, whose hash is ``hashed``, with __mx_times (0, 1, 2, ...): one join to the few rows of the plan, documents don't move.

    Rows of ``planned`` may bring more columns along (they must not be in ``docs``)."""
    p = planned.withColumnsRenamed({"passes": "__mx_passes", "below": "__mx_below"})
    out = docs.join(broadcast_if_small(p), F.col(source_col).eqNullSafe(F.col("__mx_s")))
    again = F.when(hashed < F.col("__mx_below"), 1).otherwise(0)
    return out.withColumn("__mx_times", F.col("__mx_passes") + again).drop("__mx_s", "__mx_passes", "__mx_below")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs(doc_id, source, text) -> (doc_id, size, source_size, target, taken): how many words the mix takes of each document."""
    sized = materialize(docs.select("doc_id", "source", n_words("text").alias("size"), row_hash("doc_id", "text").alias("hash")), "mix-sized")
    out = times(sized, plan(sized, weights, share, most), F.col("hash"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("__mx_times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: rows of ``docs`` (doc_id, source, text and any more columns), each as often as it is taken."""
    sized = materialize(docs.select("source", n_words("text").alias("size"), row_hash("doc_id", "text").alias("hash")), "mix-sized")
    planned = plan(sized, weights, share, most).drop("source_size", "target")
    return times(docs, planned, row_hash("doc_id", "text")).withColumn("__mx_copy", F.explode(F.array_repeat(F.lit(0), F.col("__mx_times").cast("int")))).select(*docs.columns)


#: DuckDB: the same targets and thresholds by running sums over all documents in hash order.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         sum(size)::DOUBLE * 2 AS cap
  FROM d GROUP BY source),
c AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s),
k AS (SELECT *, cap * weight_left <= weight * (budget - cap_before) AS capped FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
         weight * ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN NOT capped THEN weight END) OVER ()) END AS target
  FROM k),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
b AS (SELECT *, target - passes * source_size AS rest FROM p),
h AS (
  SELECT source, hash, sum(n) OVER (PARTITION BY source ORDER BY hash) AS upto, n
  FROM (SELECT source, hash, sum(size) AS n FROM d GROUP BY source, hash)),
r AS (
  SELECT h.source, h.hash, (upto - n <= rest AND rest < upto AND upto - rest < rest - (upto - n)) OR upto <= rest AS again
  FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.passes + CASE WHEN r.again AND b.rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
       JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.hash = r.hash
"""
