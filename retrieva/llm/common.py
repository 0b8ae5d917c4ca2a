"""Helpers shared by the operators of this subpackage.

Lineage is cut by writing to the folder in ``spark.checkpoint.dir``
(``retrieva.session.materialize``), so a lost executor costs a re-read, never a
re-run from the first input. Nothing here uses localCheckpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrieva.session import materialize

#: Largest table that is broadcast: its rows are counted first. Rows here are a few numbers wide.
MAX_BROADCAST_ROWS = 20_000
#: Records in one Arrow batch sent to Python: keeps a batch of long rows to some tens of MB.
BATCH_ROWS = 1000
#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a *written* table whose row count was checked; beyond the bound, a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: str | Column) -> Column:
    """Number of runs of characters that are not ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranged(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Position and running sum of every row in its group, in a total order, with no group in one task.

    A range shuffle on (group, order) puts neighbouring rows of a group in the same partition and splits a large
    group over several. Each (partition, group) is then numbered on its own and shifted by the sums of the partitions before it
    (one row per partition and group). Adds ``slot`` (0, 1, ...) and ``before`` (sum of ``value`` in the rows
    ahead). ``order`` must name unique keys, else equal rows are numbered in any order.
    """
    spark = df.sparkSession
    cut = materialize(df.repartitionByRange(shuffle_partitions(spark), *group, *order)
                      .withColumn("_part", F.spark_partition_id()), name)
    sums = cut.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_v0")), name + "-starts")
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    here = Window.partitionBy("_part", *group).orderBy(*order)
    return (cut.join(broadcast_if_small(starts), on)
            .withColumn("slot", (F.row_number().over(here) - 1 + F.col("_n0")).cast("long"))
            .withColumn("before", F.coalesce(F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_v0"))
            .drop("_part", "_p", "_n0", "_v0", *[f"_g{i}" for i in range(len(group))]))
