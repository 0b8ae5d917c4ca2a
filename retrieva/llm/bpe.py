"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A pre-tokenisation pattern without look-behind scans forward only: what follows a boundary doesn't depend on what came before
it. So two scans that share one boundary agree from there on. A long text is cut into chunks that overlap by a
margin; each chunk is scanned in parallel from its own start, and where the scan of chunk ``i`` running into the
margin and the scan of chunk ``i + 1`` first share a boundary, the pieces are stitched. (The first scan starts at the true
start, so by induction all stitches are true boundaries.) A stitch must follow a character that is not white space,
since a run of white space that ends a piece could otherwise be matched differently. Where nothing in a margin resynchronises
(a pre-token longer than the margin), the two chunks become one, which is scanned again; the others keep their scans. That is repeated until
every margin has a stitch, so only the chunks that a long pre-token touches grow together. Pieces are then encoded in
parallel and their ids joined in order.

Decoding joins the raw bytes of the ids.

Cases: a null text is the empty text (no ids, empty bytes); repeated rows each return a row; any id type, nulls
included, passes through, as do other columns; an empty table returns no rows; very long texts are chunked as above.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieva.session import materialize, ship_package

from .common import small_batches

#: Characters in a chunk, and in the margin that neighbouring chunks share.
CHUNK, MARGIN = 1 << 15, 1 << 11


class Vocabulary:
    """Ranks and pattern of a tokenizer as sent to the executors: the vocabulary file's bytes (about 1 MB), broadcast once."""

    _built: dict[int, tuple] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:  # a file of the tokenizer package, not an input table
            self.ranks = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def _made(self) -> tuple:
        """(encoder, bytes of each id), made once for each worker process."""
        key = hash((self.ranks.value, self.pattern))
        if key not in Vocabulary._built:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.value.splitlines())}
            enc = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            tokens = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                tokens[rank] = token
            Vocabulary._built[key] = enc, tokens
        return Vocabulary._built[key]

    def ids(self, text: Column) -> Column:
        """Little-endian unsigned 32-bit ids of a text as binary."""
        @F.pandas_udf(T.BinaryType())
        def encode(texts: pd.Series) -> pd.Series:
            enc = self._made()[0]
            return pd.Series([np.asarray(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in texts], dtype=object)

        return encode(F.coalesce(text, F.lit("")))

    def raw(self, ids: Column) -> Column:
        """Bytes that the ids stand for."""
        @F.pandas_udf(T.BinaryType())
        def decode(rows: pd.Series) -> pd.Series:
            tokens = self._made()[1]
            return pd.Series([b"".join(map(tokens.__getitem__, np.frombuffer(r, dtype="<u4").tolist())) for r in rows], dtype=object)

        return decode(F.coalesce(ids, F.lit(b"")))


def boundaries(pattern: str, chunk: str, margin: int, size: int) -> tuple[list[int], list[int]]:
    """Starts of pre-tokens after a character that is not white space: within the first ``margin`` characters, and within
    the margin that begins at ``size`` (there counted from ``size``)."""
    import regex

    head, tail = [], []
    for m in regex.finditer(pattern, chunk):
        at = m.start()
        if at and (at < margin or at >= size) and not chunk[at - 1].isspace():
            if at < margin:
                head.append(at)
            if at >= size:
                tail.append(at - size)
    return head, tail


def _parts(texts: DataFrame, spans: DataFrame, beyond: int) -> DataFrame:
    """(__bpe_row, start, stop, part): the text of each span, and ``beyond`` characters after it, dealt to all tasks.

    A text is cut in one pass over its spans; about a megabyte of characters goes into a batch."""
    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row, text, starts, stops in zip(pdf["__bpe_row"], pdf["__bpe_text"], pdf["starts"], pdf["stops"], strict=True):
                batch, n = [], 0
                for start, stop in zip(starts, stops, strict=True):
                    batch.append((row, start, stop, text[start:stop + beyond]))
                    n += stop - start
                    if n >= 1 << 20:
                        yield pd.DataFrame(batch, columns=["__bpe_row", "start", "stop", "part"])
                        batch, n = [], 0
                yield pd.DataFrame(batch, columns=["__bpe_row", "start", "stop", "part"])

    listed = spans.groupBy("__bpe_row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")).select(
        "__bpe_row", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    return (texts.select("__bpe_row", "__bpe_text").join(listed, "__bpe_row").mapInPandas(cut, "__bpe_row long, start long, stop long, part string")
            .repartition("__bpe_row", "start"))


def _scans(texts: DataFrame, spans: DataFrame, pattern: str, margin: int) -> DataFrame:
    """spans(__bpe_row, start, stop) with the boundaries ``head`` and ``tail`` of each, a written table."""
    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [boundaries(pattern, p, margin, stop - start) for p, start, stop in zip(pdf["part"], pdf["start"], pdf["stop"], strict=True)]
            yield pd.DataFrame({"__bpe_row": pdf["__bpe_row"], "start": pdf["start"], "stop": pdf["stop"], "head": [h for h, _ in found], "tail": [t for _, t in found]})

    schema = "__bpe_row long, start long, stop long, head array<int>, tail array<int>"
    return materialize(_parts(texts, spans, margin).mapInPandas(scan, schema), "bpe-scans")


def _pieces(long: DataFrame, pattern: str, size: int, margin: int) -> DataFrame:
    """long(__bpe_row, __bpe_text) -> (__bpe_row, start, stop, part): the texts cut where neighbouring scans resynchronise."""
    lengths = long.select("__bpe_row", F.length("__bpe_text").cast("long").alias("n"))
    spans = lengths.select("__bpe_row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("start")).select(
        "__bpe_row", "start", F.least("n", F.col("start") + size).alias("stop"))
    scans = _scans(long, spans, pattern, margin)
    here = Window.partitionBy("__bpe_row").orderBy("start")  # the spans of one text: its length / size rows
    while True:
        cut = F.col("start") + F.array_min(F.array_intersect("head", F.lag("tail").over(here)))
        joined = scans.withColumn("cut", F.when(F.col("start") == 0, 0).otherwise(cut))
        if joined.filter("cut IS NULL").isEmpty():
            break
        # spans up to the next one with a cut grow together; those that stay alone keep their scans
        grown = joined.withColumn("first", F.last(F.when(F.col("cut").isNotNull(), F.col("start")), ignorenulls=True).over(here))
        grown = grown.groupBy("__bpe_row", F.col("first").alias("start")).agg(
            F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n"), F.first("head").alias("head"), F.first("tail").alias("tail"))
        grown = materialize(grown, "bpe-grown")
        wide = grown.filter("n > 1").select("__bpe_row", "start", "stop")
        texts = long.join(wide.select("__bpe_row").distinct(), "__bpe_row", "left_semi")
        scans = materialize(grown.filter("n = 1").drop("n").unionByName(_scans(texts, wide, pattern, margin)), "bpe-scans")
    # a stitch lies beyond its span's start: the piece before it ends there
    until = F.coalesce(F.lead("cut").over(here), F.col("stop"))
    return _parts(long, joined.select("__bpe_row", F.col("cut").alias("start"), until.alias("stop")), 0)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", size: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``ids`` (binary, little-endian unsigned 32-bit; a column of that name makes way)."""
    if not 0 < margin < size:
        raise ValueError("the margin must be shorter than a chunk")
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    others = [c for c in docs.columns if c not in (text_col, "ids")]
    is_long = F.coalesce(F.length(text_col), F.lit(0)) > size
    short = docs.filter(~is_long).select(*others, vocabulary.ids(F.col(text_col)).alias("ids"))
    long = materialize(docs.filter(is_long).withColumn("__bpe_row", F.monotonically_increasing_id()).withColumnRenamed(text_col, "__bpe_text"), "bpe-long")
    parts = _pieces(long.select("__bpe_row", "__bpe_text"), vocabulary.pattern, size, margin).select("__bpe_row", F.col("start").alias("piece"), vocabulary.ids(F.col("part")).alias("part"))
    in_order = F.sort_array(F.collect_list(F.struct("piece", "part")))
    whole = parts.groupBy("__bpe_row").agg(F.unhex(F.array_join(F.transform(in_order, lambda p: F.hex(p["part"])), "")).alias("ids"))
    return short.unionByName(long.drop("__bpe_text").join(whole, "__bpe_row").select(*others, "ids"))


def decode(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids."""
    return coded.withColumn("decoded", vocabulary.raw(F.col(ids_col)))


def digests(coded: DataFrame) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to encoded and decoded rows."""
    return (coded.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))
            .withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("decoded", 256)))
