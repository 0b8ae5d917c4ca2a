"""SimHash near-duplicates: Golay-code fuzzy hashing of 64-bit fingerprints.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word of the perfect binary
Golay code [23, 12, 7]. Every word has one codeword within 3 bits; a word at exactly 3 bits has five more at 4 bits.
The indices of all codewords within 4 bits are the word's keys (1 or 6, 5.3 on average), and two facts hold:
words that differ in at most 2 bits share a key, and for words that differ in 1 bit the *decoded* codeword of one is among
the keys of the other.

At most 4 errors fall on three segments, so (pigeonhole) either some segment has none and another at most 2, or two
segments have exactly 1. The first case is met by keys (segment i exact, key of segment j), the second by
(decoded i, key of j) on one side against (key of i, decoded j) on the other. So the equi-join on these keys finds every
pair, and each candidate is verified by its bit distance inside the join.

Equal fingerprints are one node with their smallest document id. Neighbours in sorted order are linked first. A key that
many fingerprints of one group have is left out if it has no other group; else the largest group meets only the rest
there. So a large group of near copies costs neither all its pairs as links nor as comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieva.session import materialize, ship_package

from .common import broadcast_if_small, shuffle_partitions, small_batches
from .graph import components

#: Contract of op1, also used by the pipeline.
SHINGLE, MAX_BITS = 4, 4
#: Segment widths, low bits first.
WIDTHS = (22, 21, 21)
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR, LENGTH, PARITY = 0b101011100011, 23, 11
#: Shingles hashed at a time in a long text.
PIECE = 1 << 16
#: Fingerprints of one group that meet in a key before the key is split by group.
CROWD = 64


@cache
def _bits_of_bytes() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles as a signed integer (no words: 0)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[:len(words) - k + 1], ends[k - 1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(8 * 256, np.int64)
    for at in range(0, len(first), PIECE):
        h = np.array([digest(buf[a:b], 42) for a, b in zip(first[at:at + PIECE].tolist(), last[at:at + PIECE].tolist(), strict=True)], dtype="<u8")
        by_byte = h.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
        counts += np.bincount(by_byte.ravel(), minlength=8 * 256)
    ones = (counts.reshape(8, 256) @ _bits_of_bytes()).ravel()
    value = sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(first)))
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return of(F.coalesce(text, F.lit("")))


@cache
def _syndromes() -> tuple[np.ndarray, ...]:
    """Syndrome of each byte of a word, by position of the byte."""
    def remainder(v: int) -> int:
        for b in range(LENGTH, PARITY - 1, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - PARITY)
        return v
    return tuple(np.array([remainder(v << s) for v in range(256)], np.int64) for s in (0, 8, 16))


def _syndrome(words: np.ndarray) -> np.ndarray:
    a, b, c = _syndromes()
    return a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16 & 127]


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns of at most 4 bits that lead to a codeword: the lightest first; and how many."""
    found, n = np.zeros((1 << PARITY, 6), np.int64), np.zeros(1 << PARITY, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(LENGTH), weight)], np.int64)
        for s, p in zip(_syndrome(patterns).tolist(), patterns.tolist(), strict=True):
            found[s, n[s]] = p
            n[s] += 1
    return found, n


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word, column 0 the decoded one; and a mask of those that count."""
    found, n = _errors()
    s = _syndrome(words)
    return (words[:, None] ^ found[s]) >> PARITY, np.arange(6) < n[s][:, None]


def segments(fps: np.ndarray) -> list[np.ndarray]:
    u, out = fps.view(np.uint64), []
    for w in WIDTHS:
        out.append((u & np.uint64((1 << w) - 1)).astype(np.int64))
        u = u >> np.uint64(w)
    return out


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, key, side) of every join key; side 0 joins either way, 1 only as left, 2 only as right."""
    seg = segments(fps)
    near = [codeword_keys(s) for s in seg]
    rows, keys, sides, family = [], [], [], 0

    def add(key: np.ndarray, mask: np.ndarray, side: int) -> None:
        r, c = np.nonzero(mask)
        rows.append(r)
        keys.append(key[r, c] | np.int64(family << 40))
        sides.append(np.full(len(r), side, np.int8))

    for i in range(3):
        for j in range(3):
            if i != j:
                add(seg[i][:, None] << 12 | near[j][0], near[j][1], 0)
                family += 1
    for i, j in combinations(range(3), 2):
        add(near[i][0][:, :1] << 12 | near[j][0], near[j][1], 1)
        add(near[i][0] << 12 | near[j][0][:, :1], near[i][1], 2)
        family += 1
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def _sorted_neighbours(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links between fingerprints that agree in a segment and follow each other when the rest is sorted.

    Range partitions hold the order, so no bucket has to fit a task; links over a partition's edge are left to the join.
    """
    def order(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fps = pdf["fp"].to_numpy(np.int64)
            seg, out = segments(fps), []
            for i in range(3):
                for j in range(3):
                    if i != j:
                        out.append(pd.DataFrame({"bucket": seg[i] | (3 * i + j) << 24, "rest": seg[j] << 22 | seg[3 - i - j], "fp": fps}))
            yield pd.concat(out)

    def link(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, fp = -1, 0
        for pdf in it:
            if len(pdf):
                b, f = (np.concatenate(([x], pdf[c].to_numpy(np.int64))) for x, c in ((bucket, "bucket"), (fp, "fp")))
                near = (b[1:] == b[:-1]) & (np.bitwise_count((f[1:] ^ f[:-1]).view(np.uint64)) <= max_bits)
                yield pd.DataFrame({"a": f[:-1][near], "b": f[1:][near]})
                bucket, fp = int(b[-1]), int(f[-1])

    spark = nodes.sparkSession
    rows = nodes.select("fp").mapInPandas(order, "bucket long, rest long, fp long")
    return (rows.repartitionByRange(shuffle_partitions(spark), "bucket", "rest").sortWithinPartitions("bucket", "rest")
            .mapInPandas(link, "a long, b long"))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, side, fp, group) of every join key of nodes(fp, group)."""
    def spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fps, group = pdf["fp"].to_numpy(np.int64), pdf["group"].to_numpy(np.int64)
            rows, keys, sides = join_keys(fps)
            yield pd.DataFrame({"key": keys, "side": sides, "fp": fps[rows], "group": group[rows]})

    return nodes.select("fp", "group").mapInPandas(spread, "key long, side byte, fp long, group long")


def _crowded_keys(nodes: DataFrame) -> DataFrame:
    """Keys that more than CROWD fingerprints of one group have. Only groups of more fingerprints are looked at."""
    large = materialize(nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("group"), "simhash-large")
    members = nodes.join(large.hint("merge"), "group", "left_semi")
    counts = _keys(members).groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.filter(F.col("n") > CROWD).select("key").distinct(), "simhash-crowds")


def _split_keys(keys: DataFrame) -> DataFrame:
    """The keys that fingerprints of more than one group have, each row with whether it is of its key's largest group.

    A key of one group only can't give a link, so the keys of a group of any size that is linked already end here.
    """
    by_group = materialize(keys.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")), "simhash-sizes")
    largest = materialize(by_group.groupBy("key").agg(F.max(F.struct("n", "group"))["group"].alias("largest"), F.count(F.lit(1)).alias("groups"))
                          .filter("groups > 1").select("key", "largest"), "simhash-largest")
    return materialize(keys.join(largest.hint("merge"), "key")
                       .select("key", "side", "fp", "group", (F.col("group") == F.col("largest")).alias("main")), "simhash-keys")


def _met(keys: DataFrame, others: DataFrame, max_bits: int) -> DataFrame:
    """Verified links (a, b), a < b, between groups in ``keys`` as left and groups in ``others`` as right side."""
    left = keys.filter("side < 2").select("key", F.col("fp").alias("f"), F.col("group").alias("a"))
    right = others.filter("side != 1").select(F.col("key").alias("at"), F.col("fp").alias("g"), F.col("group").alias("b"))
    verified = (F.col("f") < F.col("g")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits)
    return left.join(right.hint("merge"), (F.col("key") == F.col("at")) & verified).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _joined(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Verified links between nodes(fp, group) of different groups, as pairs of groups.

    In a key without a crowd a fingerprint meets at most CROWD of its own group. In a crowded key the largest group meets only the others;
    these meet each other too, and none of them is larger than the largest, so no more pairs of one group are looked at than pairs
    of two groups.
    """
    keys, crowds = _keys(nodes), _crowded_keys(nodes)
    if crowds.isEmpty():
        return _met(keys, keys, max_bits).distinct()
    few = broadcast_if_small(crowds)
    split = _split_keys(materialize(keys.join(few, "key", "left_semi"), "simhash-crowded"))
    main, others = split.filter("main"), split.filter("NOT main")
    rest = keys.join(few, "key", "left_anti")
    return (_met(rest, rest, max_bits).unionByName(_met(main, others, max_bits))
            .unionByName(_met(others, main, max_bits)).unionByName(_met(others, others, max_bits)).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, text_hash, fp, component_id) for every row: xxhash64 of its text, its SimHash and the smallest id reachable over links of at most ``max_bits`` bits.

    Cases: null and empty texts, and texts of white space, have fingerprint 0 and link with each other like any other;
    fewer words than a shingle give one shingle of all words; repeated rows each return a row; a null id returns a row
    and counts as no id (if a component has only null ids, component_id is null); an empty table returns no rows.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the segment keys are proven for at most 4 differing bits")
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    prints = materialize(docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_hash"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-nodes")
    chained = components(_sorted_neighbours(nodes, max_bits), "simhash-chains")
    nodes = materialize(nodes.join(chained.withColumnRenamed("node", "fp"), "fp", "left")
                        .select("fp", "first", F.coalesce("component", "fp").alias("group")), "simhash-groups")
    merged = components(_joined(nodes, max_bits), "simhash-links")
    nodes = nodes.join(merged.withColumnRenamed("node", "group"), "group", "left").select(
        "fp", "first", F.coalesce("component", "group").alias("root"))
    roots = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is that of their component in ``found`` (of near_duplicates), repeated rows once.

    Rows in a component without any id stay, as nothing tells them apart.
    """
    found = materialize(found.select(F.col(id_col).alias("__sh_id"), F.col("text_hash").alias("__sh_hash"), F.coalesce(~F.col(id_col).eqNullSafe(F.col("component_id")) & F.col(
        "component_id").isNotNull(), F.lit(False)).alias("__sh_gone")), "simhash-found")
    gone = materialize(found.filter("__sh_gone").select("__sh_id", "__sh_hash").distinct(), "simhash-gone")
    out = docs.withColumn("__sh_own", F.xxhash64(text_col)).join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__sh_id")) & (F.col("__sh_own") == F.col("__sh_hash")), "left_anti")
    if not found.filter("NOT __sh_gone").groupBy("__sh_id", "__sh_hash").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__sh_own"])
    return out.drop("__sh_own")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
