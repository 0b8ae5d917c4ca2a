"""Line deduplication by winnowing over line hashes.

Every line of a text (outer white space aside) has a hash. From each line on, the window is the fewest lines that hold
MIN_WORDS words, and up to each line, the fewest that hold them before it; the line of smallest hash in a window, the rightmost of
equal ones, is its fingerprint and keeps its position. Two runs of equal lines with MIN_WORDS words or more contain a window in common, which picks the
same line in both: the guarantee of winnowing, whatever the lengths of the lines.

Positions are joined by fingerprint; a fingerprint chosen at one position only, in all texts, matches nothing and is dropped. From a joined
position a match is extended to the left and to the right over equal line hashes, as far as the windows reach that chose the position. Positions of one
fingerprint are grouped by what they extend over, so every distinct continuation is a group of its own with its *first* place (id, then line),
and a later position is compared with all continuations that any earlier place holds, by one row for each window: a
passage in very many documents costs one row for each, not a pair for each two. A later match is deleted. That is every line of every run
of MIN_WORDS words or more that any earlier place holds: the windows from the run's lines on that end within it reach to a
last line, and the window up to the run's end starts at or before the last of them. So no run goes on beyond its windows.

Extensions agree if two rolling hashes of 61 bits do, of independent bases: one of the lines beside the fingerprint, one of all lines. Over 10**12 windows two
different ones agree with a chance below 10**-12. Windows, minima and hashes are found in one pass, linear in the lines, blank ones included.

Cases: null text stays null; a run that overlaps its own first place in one text is no repeat of it; rows equal in id and
text are one document and are cut alike; a null id sorts first; texts shorter than MIN_WORDS words have no windows and stay; an
empty table returns no rows; a text of repeated runs only becomes empty and its row stays.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieva.session import materialize, ship_package

from .common import small_batches

MIN_WORDS = 50

_WINDOWS = "start int, n int, fp long, beside long, whole long, fresh boolean"

_PRIME = (1 << 61) - 1
_BASES = (0x1A2B3C4D5E6F701, 0x0F1E2D3C4B5A697)  # any two numbers below the prime


class _Rolling:
    """Hashes of all stretches of a sequence of numbers."""

    def __init__(self, values: list[int], base: int):
        self.before = list(accumulate(values, lambda h, v: (h * base + v) % _PRIME, initial=0))
        self.power = list(accumulate(range(len(values)), lambda p, _: p * base % _PRIME, initial=1))

    def of(self, start: int, end: int) -> int:
        return (self.before[end] - self.before[start] * self.power[end - start]) % _PRIME


def windows_of(text: str, min_words: int = MIN_WORDS) -> list[tuple]:
    """(start, lines, fingerprint, hash of the lines left and right of it, hash of all lines, first pick of that line) of each window, from a line on
    or up to a line."""
    import xxhash

    lines = text.split("\n")
    words = [len(x.split()) for x in lines]
    if sum(words) < min_words:
        return []
    h = [xxhash.xxh64_intdigest(x.strip().encode("utf-8", "surrogatepass")) for x in lines]
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(lines))
    # the first end with min_words from a start on, the last start with min_words up to an end
    ends = np.searchsorted(total, total[:-1] + min_words, side="left")
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    spans = set(zip(at[ends <= len(lines)].tolist(), ends[ends <= len(lines)].tolist(), strict=True))
    spans.update(zip(starts[starts >= 0].tolist(), (at + 1)[starts >= 0].tolist(), strict=True))
    one, two = (_Rolling(h, base) for base in _BASES)
    out, seen, least, past = [], set(), deque(), 0
    for start, end in sorted(spans):  # neither starts nor ends go back, so the minima come from one queue
        for past in range(past, end):
            while least and h[least[-1]] >= h[past]:
                least.pop()
            least.append(past)
        past = end
        while least[0] < start:
            least.popleft()
        picked = least[0]
        left, right = one.of(start, picked), one.of(picked + 1, end)
        beside = ((left * one.power[end - picked - 1] + right) * _BASES[1] + picked - start) % _PRIME
        out.append((start, end - start, h[picked] - (1 << 63), beside, two.of(start, end), picked not in seen))
        seen.add(picked)
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, runs): for each document with repeats, the spans (first line, last line) to delete. doc is a struct of id and text hash."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _WINDOWS.split(", ")]
        for pdf in it:
            rows = [(i, t, *w) for i, t, text in zip(pdf["id"], pdf["th"], pdf["text"], strict=True) if text for w in windows_of(text, min_words)]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "th", *names])

    # ids travel as text, so that any type passes through pandas unchanged
    keyed = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType
    w = materialize(keyed.mapInPandas(cut, "id string, th long, " + _WINDOWS)
                    .withColumn("place", F.struct(F.col("id").cast(id_type).alias("id"), "th", "start")).drop("id", "th", "start"), "line-windows")
    # the other sides of these joins are written, unique in the key and grow with the input: sort-merge joins, in which
    # Spark splits a hot fingerprint or window, at every size
    again = materialize(w.filter("fresh").groupBy("fp").count().filter("count > 1").select("fp"), "line-again")
    w = materialize(w.drop("fresh").join(again.hint("merge"), "fp", "left_semi"), "line-candidates")
    match = ["fp", "beside", "whole"]
    first = w.groupBy(*match).agg(F.min("place").alias("fplace"), F.count(F.lit(1)).alias("places")).filter("places > 1").drop("places")
    m = w.join(materialize(first, "line-first").hint("merge"), match).select("place", "n", "fplace")
    one_text = F.col("place.id").eqNullSafe(F.col("fplace.id")) & (F.col("place.th") == F.col("fplace.th"))
    m = m.filter(~(one_text & (F.col("place.start") - F.col("fplace.start") < F.col("n"))))
    span = F.struct(F.col("place.start").alias("first"), (F.col("place.start") + F.col("n") - 1).cast("int").alias("last"))
    return m.groupBy(F.struct(F.col("place.id").alias("id"), F.col("place.th").alias("th")).alias("doc")).agg(F.collect_set(span).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later repeated runs of lines; adds n_lines and n_removed (null text: 0 and 0)."""
    runs = materialize(repeated_runs(docs, id_col, text_col, min_words).select(
        F.col("doc.id").alias("__ld_id"), F.col("doc.th").alias("__ld_hash"), "runs"), "line-runs").withColumnRenamed("runs", "__ld_runs")

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
    def without(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, firsts, lasts, strict=True):
            if a is None or text is None:
                out.append((text, 0))
                continue
            lines = text.split("\n")
            step = np.zeros(len(lines) + 1, np.int64)
            np.add.at(step, np.asarray(a, np.int64), 1)
            np.add.at(step, np.asarray(b, np.int64) + 1, -1)
            keep = np.cumsum(step)[:-1] <= 0
            out.append(("\n".join(x for x, k in zip(lines, keep, strict=True) if k), int((~keep).sum())))
        return pd.DataFrame(out, columns=["text", "removed"])

    on = F.col(id_col).eqNullSafe(F.col("__ld_id")) & (F.col("__ld_own") == F.col("__ld_hash"))
    cut = docs.withColumn("__ld_own", F.xxhash64(text_col)).join(runs.hint("merge"), on, "left").withColumn("__ld_cut", without(text_col, "__ld_runs.first", "__ld_runs.last"))
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n")))
    return cut.withColumn("n_lines", lines).withColumn("n_removed", F.col("__ld_cut.removed")).withColumn(text_col, F.col("__ld_cut.text")).drop("__ld_id", "__ld_hash", "__ld_own", "__ld_runs", "__ld_cut")
