"""Q1: questions arrive as JSON lines; each micro-batch is answered and appended.

``foreachBatch`` runs the batch answering job on the micro-batch and overwrites ``<out>/answers/batch_id=<id>``, so a replayed batch (after a
failure) rewrites the same folder: exactly-once output with a checkpointed source. Lines that are no question are kept aside in
``<out>/broken/batch_id=<id>``. A question id that came before, in this batch or an earlier one, is dropped by state (the first line
to arrive counts): the state holds each id once, in the checkpoint folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

QUESTION_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("text", T.StringType())])


def parse_questions(lines: DataFrame) -> DataFrame:
    """(key, query_id, text, broken) of lines (value): ``broken`` is the line itself when it isn't a JSON question with an id, else null. ``key`` tells
    questions apart by id and broken lines by their text."""
    schema = T.StructType([*QUESTION_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    q = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.col("q").isNull() | F.col("q._bad").isNotNull() | F.col("q.query_id").isNull()
    p = lines.select("value", q.alias("q")).filter(F.trim("value") != "")
    return p.select(F.when(bad, F.concat(F.lit("line "), F.sha2(F.col("value").cast("binary"), 256))).otherwise(F.concat(F.lit("id "), F.col("q.query_id").cast("string"))).alias("key"),
                    "q.query_id", "q.text", F.when(bad, F.col("value")).alias("broken"))


def answer_stream(spark: SparkSession, in_dir: str, out_dir: str,
                  answer_batch: Callable[[DataFrame], DataFrame],
                  checkpoint: str, available_now: bool = True):
    """Start the stream; returns the StreamingQuery.

    ``checkpoint`` is a lasting folder in shared storage: a restart with the same one goes on after the last
    committed batch, so no question is answered twice. ``answer_batch(questions_df) -> answers_df`` is any batch job (for example
    hybrid retrieval + prompt + generator)."""
    src = parse_questions(spark.readStream.text(in_dir)).dropDuplicates(["key"])

    def each(batch: DataFrame, batch_id: int) -> None:
        # the batch is read several times; a stateful one must be computed once
        rows = materialize(batch, f"stream-batch-{batch_id}")
        answer_batch(rows.filter("broken IS NULL").select("query_id", "text")).write.mode("overwrite").parquet(os.path.join(out_dir, "answers", f"batch_id={batch_id}"))
        rows.filter("broken IS NOT NULL").select(F.col("broken").alias("line")).write.mode("overwrite").parquet(os.path.join(out_dir, "broken", f"batch_id={batch_id}"))

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
