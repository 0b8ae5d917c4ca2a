"""Ranking operators: per-group top-k (W1/W3/W4) and full per-group ranking.

Scores are rounded to 6 decimals before ranking and ties break on the id, so
Spark and any other engine agree on order despite float summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, sent_if_small

SCORE_DIGITS = 6


def ranked_score(c) -> Column:
    """``round(c, SCORE_DIGITS)``. Spark rounds a double through its decimal text; away from halves, a whole number of millionths
    is the same one, and the division gives the double next to it."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    unit = 10.0 ** SCORE_DIGITS
    plain = (F.abs(c) < 1000.0) & (F.abs(F.pmod(c * unit, F.lit(1.0)) - 0.5) > 1e-5)
    return F.when(plain, F.floor(c * unit + 0.5) / unit).otherwise(F.round(c, SCORE_DIGITS))


def top_k(df: DataFrame, group_col: str, order: list[Column], k: int | None,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group in ``order``.

    ``row_number() <= k`` is planned as WindowGroupLimit: a partial limit runs
    before the shuffle, so each map task sends at most ``k`` rows per group and
    a hot group never lands whole in one task.
    """
    if k is None:
        return rank_all(df, group_col, order, rank_col)
    w = Window.partitionBy(group_col).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def rank_all(df: DataFrame, group_col: str, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """Full 1-based ranking within each group without putting a group in one task.

    A range shuffle on (group, order) spreads a large group over several
    partitions; each partition numbers its rows locally, and a small table of
    per-(partition, group) counts gives each partition its offset. The ranged
    rows are written once, so the counts and the rows can't disagree.
    """
    sort_cols = [F.col(group_col)] + list(order)
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    s = materialize(df.repartitionByRange(int(n), *sort_cols).sortWithinPartitions(*sort_cols)
                    .withColumn("__pid", F.spark_partition_id())
                    .withColumn("__mid", F.monotonically_increasing_id()), "ranked")
    stats = s.groupBy("__pid", group_col).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    before = Window.partitionBy(group_col).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    stats, few = sent_if_small(stats, "rank-offsets")  # a partition has few groups, or a group many partitions
    out = s.join(F.broadcast(stats) if few else stats, ["__pid", group_col])
    return (out.withColumn(rank_col, (F.col("__mid") - F.col("__first") + F.col("__off") + 1).cast("bigint"))
               .drop("__pid", "__mid", "__n", "__first", "__off"))
