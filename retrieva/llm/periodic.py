"""Periodic runs of words, solved in tiles.

A run is a stretch of words with smallest period q (words q apart are identical) that holds 2 q words and MIN_LENGTH words or more and that no
neighbouring word extends. A run of period q shows in any window of 2 q words, so periods up to TILE / 4 are found in tiles of TILE words that
overlap by half, the next octave of periods in tiles of twice the length, and so on, until one tile holds the whole text. Texts are cut into such
tiles, every tile is solved by itself wherever it lands, and the fragments that neighbouring tiles found of one run are put together by
(document, period): two of them overlap by a period or more exactly if they are one run.

In a tile, periods from P to 2 P have boundaries every P / 2 words. Any run with such a period repeats a whole block between two boundaries q words
on, so block hashes name the shifts worth a look; at those the two Z-functions of the boundary (how far the words from it on, and
the words before it, agree with those q further) are read off by comparing the words. Both together are the longest stretch with that
period. Shifts by a multiple of a shorter period inside a run of that period are skipped: the stretch there is that run.

Words travel as numbers given inside their text, so they are equal exactly if the words are. A run repeats MIN_LENGTH / 2 words in
a row at least, so texts and tiles in which no such sequence occurs twice have no run: they are finished where they are read, and their
texts don't move.

Cases: a null text has no words; a text without runs is kept whole; rows equal in id and text are solved once each and get the
same answer; null ids are ids like others; extra columns stay unread; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieva.session import materialize, ship_package

from .common import WORD_PATTERN, shuffle_partitions, small_batches

MIN_LENGTH = 12
#: Words of the shortest tiles; periods up to a fourth of it are found there.
TILE = 8192
#: Periods below are compared directly, word by word.
_DIRECT = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)  # any odd number: hashes only name candidates, words decide


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters that are not ASCII white space (bytes.split() splits at exactly those)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence's place among the distinct words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int32, count=len(words))


def _grams(s: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n numbers."""
    with np.errstate(over="ignore"):
        out, have, power = s.astype(np.uint64) * _MIX + np.uint64(1), 1, _MIX
        while have < n:
            step = min(have, n - have)  # blocks may overlap: equal runs still have equal hashes
            out = out[:len(out) - step] * power + (out[step:] ^ (out[step:] >> np.uint64(29)))
            have, power = have + step, power * _MIX
    return out


def may_repeat(s: np.ndarray, min_length: int = MIN_LENGTH) -> bool:
    """Whether any run of min_length / 2 numbers occurs twice; without one there is no run."""
    n = max(1, min_length // 2)
    if len(s) <= n:
        return False
    g = np.sort(_grams(s, n))
    return bool((g[1:] == g[:-1]).any())


def _agree(s: np.ndarray, a: int, b: int, step: int) -> int:
    """For how many words s[a], s[a + step], ... equal s[b], s[b + step], ... (a < b): one value of a boundary's Z-function."""
    n, done, chunk = (len(s) - b if step > 0 else a + 1), 0, 64
    while done < n:
        k = min(chunk, n - done)
        if step > 0:
            same = s[a + done:a + done + k] == s[b + done:b + done + k]
        else:
            same = s[a - done - k + 1:a - done + 1][::-1] == s[b - done - k + 1:b - done + 1][::-1]
        miss = int(same.argmin())
        if not same[miss]:
            return done + miss
        done, chunk = done + k, chunk * 4
    return n


def _primitive(s: np.ndarray, x: int, q: int) -> bool:
    """Whether q is the smallest period of the 2 q words from x on (a smaller one would divide it)."""
    rest, r = q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            d = q // r
            if np.array_equal(s[x:x + 2 * q - d], s[x + d:x + 2 * q]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def solve_tile(s: np.ndarray, low: int, high: int, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, past the end, period) of every longest stretch of s with a smallest period from ``low`` to below ``high``, of 2 periods and min_length words or more."""
    n, found = len(s), []
    high = min(high, n // 2 + 1)
    for q in range(low, min(high, _DIRECT)):
        need = max(q, min_length - q)
        edge = np.diff(np.concatenate(([0], (s[q:] == s[:-q]).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for x, y in zip(starts[ends - starts >= need].tolist(), ends[ends - starts >= need].tolist(), strict=True):
            if _primitive(s, x, q):
                found.append((x, y + q, q))
    p = _DIRECT
    while p < high:
        if 2 * p > low:
            found += _octave(s, max(p, low), min(2 * p, high), p, min_length, found)
        p *= 2
    return found


def _octave(s: np.ndarray, low: int, high: int, p: int, min_length: int, shorter: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of periods from low to below high, all from p to below 2 p."""
    m, n, found = p // 2, len(s), []
    g = _grams(s, m)
    blocks = np.arange(0, max(0, len(g) - low), m)  # boundaries whose block has a place q further
    if not len(blocks):
        return found
    # row: boundary; column: shift; a pair where the block is the same is worth a look
    ahead = np.concatenate([g, np.zeros(high, np.uint64)])
    shifts = np.lib.stride_tricks.sliding_window_view(ahead, high - low)[blocks + low]
    same = shifts == g[blocks][:, None]
    same &= (blocks[:, None] + np.arange(low, high)[None, :]) < len(g)
    for x, y, d in shorter:  # inside a run of period d, a shift by a multiple of d gives that run again
        if y - x > low:
            a, b = np.searchsorted(blocks, x), np.searchsorted(blocks, y - low)
            for q in range(-(-low // d) * d, high, d):
                past = min(b, int(np.searchsorted(blocks, y - q)))
                if past > a:
                    same[a:past, q - low] = False
    at, shift = np.nonzero(same.T)[::-1]
    known, of = 0, -1
    for c, q in zip(blocks[at].tolist(), (shift + low).tolist(), strict=True):
        if q != of:
            known, of = 0, q
        if c < known:
            continue
        after = _agree(s, c, c + q, 1)
        before = _agree(s, c - 1, c + q - 1, -1) if c else 0
        known = c + max(after, 1)  # further boundaries of this stretch give it again
        x, y = c - before, c + after + q
        if y - x >= max(2 * q, min_length) and _primitive(s, x, q):
            found.append((x, y, q))
    return found


def tiles_of(s: np.ndarray, tile: int = TILE, min_length: int = MIN_LENGTH) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(offset, lowest period, past the highest, words) of the tiles of one text that may hold a run."""
    low, length, n = 1, tile, len(s)
    while True:
        high = length // 4 + 1 if length < n else n // 2 + 1
        step = length // 2
        for at in range(0, max(1, n - step), step):
            part = s[at:at + length]
            if may_repeat(part, min_length):
                yield at, low, high, part
        if length >= n:
            return
        low, length = high, length * 2


_KEY = ["doc_id", "_hash", "_n"]


def prepare(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, _hash, _n, n_words, whole, body): one row for each document. Without a repeated sequence of words, ``whole`` is the SHA-256 of its words
    joined by spaces and body is null; else body is its words joined by spaces."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.coalesce(F.length("text"), F.lit(-1)).alias("_n"), "text")
    schema = T.StructType([keyed.schema[c] for c in _KEY]).add("n_words", "long").add("whole", "string").add("body", "binary")

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts, whole, bodies = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                body = b" ".join(words)
                again = may_repeat(numbered(words), min_length)
                counts.append(len(words))
                whole.append(None if again else hashlib.sha256(body).hexdigest())
                bodies.append(body if again else None)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in _KEY], pa.array(counts, pa.int64()), pa.array(whole, pa.string()), pa.array(bodies, pa.binary())],
                                             names=[*_KEY, "n_words", "whole", "body"])

    return keyed.mapInArrow(look, schema)


def runs_of(prepared: DataFrame, tile: int = TILE, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, _hash, _n, start, length, period) of every run of the documents with a body."""
    spark = prepared.sparkSession
    key = [prepared.schema[c] for c in _KEY]
    cut_schema = T.StructType(list(key)).add("at", "long").add("low", "long").add("high", "long").add("words", "binary")
    found_schema = T.StructType(list(key)).add("start", "long").add("past", "long").add("period", "long")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, body in enumerate(b.column("body").to_pylist()):
                for at, low, high, part in tiles_of(numbered(body.split(b" ")), tile, min_length):  # one tile a batch: bounded memory
                    row = [b.column(k).slice(i, 1) for k in _KEY] + [pa.array([x], pa.int64()) for x in (at, low, high)] + [pa.array([part.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=[*_KEY, "at", "low", "high", "words"])

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            of, rows = [], [[], [], []]
            for i, (at, low, high, words) in enumerate(zip(*[b.column(c).to_pylist() for c in ("at", "low", "high", "words")], strict=True)):
                for x, y, q in solve_tile(np.frombuffer(words, np.int32), low, high, min_length):
                    of.append(i)
                    for c, v in zip(rows, (x + at, y + at, q), strict=True):
                        c.append(v)
            keys = b.select(_KEY).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, *[pa.array(c, pa.int64()) for c in rows]], names=[*_KEY, "start", "past", "period"])

    # tiles go to any task, so those of a long document are solved side by side
    tiles = prepared.filter("body IS NOT NULL").select(*_KEY, "body").mapInArrow(cut, cut_schema).repartition(shuffle_partitions(spark))
    parts = tiles.mapInArrow(solve, found_schema).distinct()
    # one document and period: at most two fragments for each half tile
    order = Window.partitionBy(*_KEY, "period").orderBy("start", "past")
    reach = F.max("past").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_new", (reach.isNull() | (F.col("start") + F.col("period") > reach)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = parts.groupBy(*_KEY, "period", "_run").agg(F.min("start").alias("start"), F.max("past").alias("past"))
    return runs.select(*_KEY, "start", (F.col("past") - F.col("start")).alias("length"), "period")


def collapsed(prepared: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, kept_sha256) of every document: its runs as an array of (start, length, period) by start, then period, and the SHA-256 of its
    words without those that a run repeats after its first period, joined by spaces."""
    each = runs.groupBy(*[F.col(c).alias(f"_r{c}") for c in _KEY]).agg(F.sort_array(F.collect_set(F.struct("start", "period", "length"))).alias("_runs"))
    on = F.col("doc_id").eqNullSafe(F.col("_rdoc_id")) & (F.col("_hash") == F.col("_r_hash")) & (F.col("_n") == F.col("_r_n"))
    open_ = prepared.filter("body IS NOT NULL").join(each.hint("merge"), on, "left").select("doc_id", "n_words", "body", "_runs")
    run = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = T.StructType([prepared.schema["doc_id"]]).add("n_words", "long").add("runs", T.DataType.fromDDL(run)).add("kept_sha256", "string")
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def drop(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            runs, kept = [], []
            for body, found in zip(b.column("body").to_pylist(), b.column("_runs").to_pylist(), strict=True):
                words, found = body.split(b" "), found or []
                step = np.zeros(len(words) + 1, np.int64)
                for r in found:
                    step[r["start"] + r["period"]] += 1
                    step[r["start"] + r["length"]] -= 1
                keep = np.flatnonzero(np.cumsum(step)[:-1] == 0)
                runs.append([{"start": r["start"], "length": r["length"], "period": r["period"]} for r in found])
                kept.append(hashlib.sha256(b" ".join([words[i] for i in keep.tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(runs, arrow), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "runs", "kept_sha256"])

    done = prepared.filter("body IS NULL").select("doc_id", "n_words", F.array().cast(run).alias("runs"), F.col("whole").alias("kept_sha256"))
    return done.unionByName(open_.mapInArrow(drop, schema))


def periodic_runs(docs: DataFrame, tile: int = TILE, min_length: int = MIN_LENGTH) -> DataFrame:
    """The whole job over docs (doc_id, text)."""
    prepared = materialize(prepare(docs, min_length), "periodic-documents")
    return collapsed(prepared, runs_of(prepared, tile, min_length))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document (ties: smallest start, then period) and the digests of its runs."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise(""))
    f = found.withColumn("_best", best)
    length, period = -F.col("_best.less"), F.col("_best.period")
    return f.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), length.alias("length"), period.alias("period"),
                    F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                    F.col("kept_sha256").alias("collapsed_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), of which one in ten (by the crc32 of the id) repeats itself: from word a on, its words are those of one period p, again and
    again. Null ids and texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD_PATTERN})"))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_w")).withColumn("_k", F.size("_w").cast("long"))
    d = d.withColumn("_a", F.when(F.col("_k") > 0, F.col("_g") % F.col("_k")))
    d = d.withColumn("_p", 1 + F.floor((F.col("_k") - F.col("_a")) / (3 + F.col("_g") % 8)))
    at = F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)
    again = F.transform(at, lambda i: F.get("_w", F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i).cast("int")))
    return d.select("doc_id", F.when(F.col("_k") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
