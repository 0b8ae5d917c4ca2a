"""Batch jobs around model calls.

U1 embeds texts: the default encoder is feature hashing written in Spark SQL
(md5 bucket and sign per token, counts, L2 norm), so it runs as a grouped
aggregate; a real encoder plugs in through ``mapInPandas``.

U2 answers prompts with a pluggable generator in ``mapInPandas``: one retry
after a pause, then a sentinel answer; requests within a task are spaced.
A per-task pause caps each task's rate, so the global rate is the number of
concurrent tasks times that; ``max_requests_per_minute`` derives both.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import retrieval_tokens
from ..session import materialize, shared_fs, ship_package

ERROR_ANSWER = "[ERROR]"


# --- U1: encoders -------------------------------------------------------------------

def hashed_embeddings(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """U1 default: signed feature hashing of retrieval tokens, L2-normalised.

    Output (id, embedding ARRAY<DOUBLE>) of length ``dim``; a text without
    tokens gets the zero vector."""
    tok = df.select(F.col(id_col), F.explode(retrieval_tokens(text_col)).alias("tok"))
    h = F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("bigint")
    sign = F.when(F.conv(F.substring(F.md5("tok"), 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    cells = (tok.select(id_col, F.pmod(h, F.lit(dim)).cast("int").alias("b"), sign.alias("s"))
                .groupBy(id_col, "b").agg(F.sum("s").alias("v")))
    per = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"),
                                    F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.coalesce(F.col("m")[i] / F.nullif(F.col("n"), F.lit(0.0)), F.lit(0.0)))
    out = per.select(id_col, vec.alias("embedding"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return (df.select(id_col).join(out, id_col, "left")
              .select(id_col, F.coalesce("embedding", zero).alias("embedding")))


def model_embeddings(df: DataFrame, id_col: str, text_col: str,
                     encode: Callable[[list[str]], "list[list[float]]"], batch_size: int = 32) -> DataFrame:
    """U1 with a real encoder: ``encode(texts) -> vectors`` runs per Arrow batch
    on the executors (the model loads once per task)."""
    ship_package(df.sparkSession)
    id_type = df.schema[id_col].dataType

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i:i + batch_size]
                vecs = encode(part[text_col].fillna("").tolist())
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": [list(map(float, v)) for v in vecs]})

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return df.select(id_col, text_col).mapInPandas(run, schema)


# --- U2: generator ------------------------------------------------------------------

def extractive_generator(prompt_text: str) -> str:
    """Deterministic stand-in generator: every retrieved passage, whole, as it stands in the prompt."""
    body = prompt_text.split("Context:\n", 1)[-1].rsplit("\n\nQuestion:\n", 1)[0]
    return " " + body.strip("\n")


def _ask(generator: Callable[[str], str], prompt: str, retries: int, retry_wait: float, failure: str) -> tuple[str, int, bool]:
    """(answer, attempts, failed for good) of one prompt."""
    n = 0
    while True:
        n += 1
        try:
            return generator(prompt), n, False
        except Exception:  # noqa: BLE001 - any generator failure is retried
            if n > retries:
                return failure, n, True
            time.sleep(retry_wait)


def generate(df: DataFrame, generator: Callable[[str], str] = extractive_generator,
             prompt_col: str = "prompt", keep: list[str] | None = None, retries: int = 1,
             retry_wait: float = 2.0, spacing: float = 0.0, failure: str = ERROR_ANSWER,
             partitions: int | None = None, max_requests_per_minute: float | None = None) -> DataFrame:
    """(keep..., answer, attempts, error) for every prompt.

    ``retries`` further attempts after a failure, ``retry_wait`` seconds apart;
    after the last failure the answer is ``failure`` and ``error`` is true.
    ``spacing`` seconds pass after every request inside a task. With
    ``max_requests_per_minute`` the prompts are dealt over ``partitions`` tasks
    (the cluster's task slots unless given), each of which keeps its share of the rate."""
    ship_package(df.sparkSession)
    keep = keep or [c for c in df.columns if c != prompt_col]
    if max_requests_per_minute:
        partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
        spacing = max(spacing, 60.0 * partitions / max_requests_per_minute)
    src = df.select(*keep, prompt_col)
    if partitions:
        src = src.repartition(partitions)
    fields = [f for f in src.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField("answer", T.StringType()),
                                    T.StructField("attempts", T.IntegerType()),
                                    T.StructField("error", T.BooleanType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            answers, attempts, errors = [], [], []
            for p in pdf[prompt_col].tolist():
                ans, n, err = _ask(generator, p, retries, retry_wait, failure)
                answers.append(ans)
                attempts.append(n)
                errors.append(err)
                if spacing:
                    time.sleep(spacing)
            out = pdf[keep].copy()
            out["answer"] = answers
            out["attempts"] = pd.Series(attempts, dtype="int32")
            out["error"] = errors
            yield out

    return src.mapInPandas(run, schema)


# --- U2 with a ledger: no prompt is asked twice ------------------------------------------

LEDGER = "key string, answer string, attempts int, error boolean"


def prompt_key(prompt) -> F.Column:
    """What the ledger knows a prompt by."""
    return F.sha2(F.col(prompt).cast("binary"), 256)


def read_ledger(spark, ledger: str) -> DataFrame:
    """(key, answer, attempts, error), one row for each prompt asked so far: an answer goes before a failure, then the smallest text counts."""
    fs, root = shared_fs(ledger)
    fs.create_dir(root, recursive=True)
    rows = spark.read.schema(LEDGER).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(ledger)
    return rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("error", "answer", "attempts")).alias("b")).select("key", "b.answer", "b.attempts", "b.error")


def generate_once(df: DataFrame, ledger: str, generator: Callable[[str], str] = extractive_generator, prompt_col: str = "prompt", keep: list[str] | None = None,
                  retries: int = 1, retry_wait: float = 2.0, spacing: float = 0.0, failure: str = ERROR_ANSWER, partitions: int | None = None,
                  flush: int = 1, ask_failures_again: bool = True) -> DataFrame:
    """U2 with a ledger: (keep..., answer, attempts, error) for every prompt, each distinct prompt being asked once.

    ``ledger`` is a lasting folder in shared storage. A task writes its answers there as they come, ``flush`` of them in a file, into the folder of its
    share of the prompt keys. Before asking, it reads that folder: what an earlier attempt of the task (lost with its executor) or an
    earlier run has answered isn't asked again; at most ``flush - 1`` answers are lost with a task. Prompts that the ledger holds when the job starts are
    taken out by an anti-join. With ``ask_failures_again`` prompts that failed for good in an earlier run get another chance. Null prompts are
    asked as the empty text. The result is read from the ledger, so using it twice asks nothing."""
    spark = df.sparkSession
    ship_package(spark)
    keep = keep or [c for c in df.columns if c != prompt_col]
    src = materialize(df.select(*keep, F.coalesce(prompt_col, F.lit("")).alias("__prompt")).withColumn("__key", prompt_key("__prompt")), "prompts")
    old = read_ledger(spark, ledger)
    done = materialize((old.filter("NOT error") if ask_failures_again else old).select(F.col("key").alias("__key")), "answered")
    n = partitions or spark.sparkContext.defaultParallelism
    run_id = uuid.uuid4().hex[:12]
    open_ = src.select("__key", "__prompt").distinct().join(done, "__key", "left_anti")
    # the share of a key is the same in every attempt of this run
    shares = open_.withColumn("__share", F.pmod(F.xxhash64("__key"), F.lit(n)).cast("int")).repartitionById(n, F.col("__share")).sortWithinPartitions("__key")

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = shared_fs(ledger)
        folder, known = None, set()

        def write(rows: list[dict]) -> None:
            text = "".join(json.dumps(r) + "\n" for r in rows)
            name = f"{folder}/{hashlib.sha256(text.encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"
            with fs.open_output_stream(name + ".part") as f:  # a half-written file never has the name that readers look for
                f.write(text.encode())
            fs.move(name + ".part", name + ".jsonl")

        asked = 0
        for pdf in it:
            rows = []
            for key, prompt, share in zip(pdf["__key"], pdf["__prompt"], pdf["__share"], strict=True):
                if folder is None:
                    folder = f"{root}/run={run_id}/share={share}"
                    fs.create_dir(folder, recursive=True)
                    known = _keys_in(fs, folder)
                if key in known:
                    continue
                answer, attempts, error = _ask(generator, prompt, retries, retry_wait, failure)
                rows.append({"key": key, "answer": answer, "attempts": attempts, "error": error})
                asked += 1
                if len(rows) >= flush:
                    write(rows)
                    rows = []
                if spacing:
                    time.sleep(spacing)
            if rows:
                write(rows)
        yield pd.DataFrame({"asked": [asked]})

    materialize(shares.mapInPandas(ask, "asked long"), "asked")
    answers = materialize(read_ledger(spark, ledger), "ledger").withColumnRenamed("key", "__k")
    return src.join(answers, F.col("__key") == F.col("__k")).select(*keep, "answer", "attempts", "error")


def _keys_in(fs, folder: str) -> set[str]:
    """Keys answered in one share's folder."""
    from pyarrow.fs import FileSelector
    out = set()
    for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".jsonl"):
            with fs.open_input_stream(info.path) as f:
                out.update(json.loads(x)["key"] for x in f.read().decode().splitlines() if x)
    return out
