"""Spelling variant grouping with a dictionary of trie-node pairs.

All distinct words stand in two tries, one of the words and one of the reversed words, and every trie node has a number. A word cut at a position is
the integer pair (node of what stands before, node of what stands after). Two words are one inserted or deleted letter
apart exactly if a pair of the one, cut between two letters, is a pair of the other with a letter skipped; they are one replaced letter apart
exactly if they share a pair with the same letter skipped. So all neighbours come from one equality of integer pairs.

Numbering. Words are sorted by range partitions. In sorted order a word shares its path with the word before it up to
their common prefix, and the rest of its path are new nodes, numbered as they come: one pass, linear in the letters. Where a partition starts
inside a path of the partition before it, the numbers of that shared path are mended from one row for each partition, which
holds its first and last word. No strings of prefixes are built, so a word of any length costs its length.

A pair with a letter skipped is held by one word for each letter that may stand there, so a group has at most as many members as there are letters
in use (90 in ``WORD``), and one word cut there. Neighbours in a group are counted and the best two kept in the row; no pairs of
words are made.

Cases: a null text has no words; an empty table, or one without a repeated word, gives no rows; a null id takes part as the empty text; rows
that are repeated count again; words of equal count are ordered by code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieva.session import materialize, ship_package

from .common import ascii_lower, shuffle_partitions, small_batches

MIN_LETTERS, MIN_COUNT, MIN_RATIO = 7, 2, 10
WORD = "[A-Za-z\\u00C0-\\u00FF]"
#: Numbers of nodes: partition above, number in the partition below this bit.
_BITS = 40


def vocabulary(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words (one row for each occurrence) with enough letters and occurrences; counted before they are shuffled."""
    return words.filter(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def number_nodes(words: DataFrame, name: str) -> DataFrame:
    """``words`` (word unique) with ``path``: the numbers of its trie nodes from the root (0) to its end. The last number of a path is the
    word's own, and grows in the order of the words."""
    spark = words.sparkSession
    ship_package(spark)
    small_batches(spark)

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last, path, made = TaskContext.get().partitionId() << _BITS, None, [0], 0
        first, held = None, None
        for b in it:
            if b.num_rows == 0:
                continue
            texts, paths = b.column("word").to_pylist(), []
            for w in texts:
                if last is None:
                    first, same = w, 0
                else:
                    same, most = 0, min(len(w), len(last))
                    while same < most and w[same] == last[same]:
                        same += 1
                path = path[:same + 1] + list(range(base + made + 1, base + made + 1 + len(w) - same))
                made += len(w) - same
                last = w
                paths.append(path)
            if held is not None:
                yield held
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(paths, pa.list_(pa.int64())), pa.array([base >> _BITS] * len(texts), pa.int32())],
                                             names=[*b.schema.names, "path", "part"])
            held = out.append_column("first", pa.array([None] * len(texts), pa.string()))
        if held is not None:  # the last word of a partition carries the first one
            edge = pa.array([None] * (held.num_rows - 1) + [first], pa.string())
            yield held.set_column(held.schema.names.index("first"), "first", edge)

    schema = T.StructType(list(words.schema)).add("path", T.ArrayType(T.LongType())).add("part", "integer").add("first", "string")
    ordered = words.repartitionByRange(shuffle_partitions(spark), "word").sortWithinPartitions("word")
    walked = materialize(ordered.mapInArrow(walk, schema), name)

    def mend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partition by partition: the true numbers of the path that its first word shares with the last word before it."""
        before, true = "", [0]
        for b in it:
            parts, shared = [], []
            for part, word, path, first in zip(*[b.column(c).to_pylist() for c in ("part", "word", "path", "first")], strict=True):
                same, most = 0, min(len(first), len(before))
                while same < most and first[same] == before[same]:
                    same += 1
                mine, base = true[1:same + 1], part << _BITS
                # the first word's path has the local numbers 1, 2, ...: those up to the common prefix are the earlier nodes
                true = [0] + [mine[x - base - 1] if x - base <= same else x for x in path[1:]]
                before = word
                parts.append(part)
                shared.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(shared, pa.list_(pa.int64()))], names=["_part", "_shared"])

    edges = walked.filter("first IS NOT NULL").select("part", "word", "path", "first")
    # one row for each partition, streamed in order
    edges = materialize(edges.repartition(1).sortWithinPartitions("part").mapInArrow(mend, "_part int, _shared array<bigint>"), name + "-edges")
    base = F.col("part").cast("long") * (1 << _BITS)
    at = F.col("_shared")
    whole = F.transform("path", lambda x: F.when((x > 0) & (x - base <= F.size(at)), F.get(at, (x - base - 1).cast("int"))).otherwise(x))
    return walked.join(edges.hint("merge"), F.col("part") == F.col("_part")).withColumn("path", whole).drop("part", "first", "_part", "_shared")


def _before(member: Column, other: Column) -> Column:
    """Whether ``other`` counts as a neighbour of ``member`` in their group. A skipped letter that follows its like is left to the first of them, so
    that a deletion that several positions give counts once."""
    return (member["id"] != other["id"]) & F.when(other["skip"], member["skip"] | other["lead"]).otherwise(member["skip"] & member["lead"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, id, n, n_near, best) for words (word, n): the number of words one edit away, and the best of them as (minus its count, its id): the
    most frequent, ties by code points. Words without neighbours have 0 and null."""
    forward = number_nodes(words, "spelling-forward")
    backward = number_nodes(words.select(F.reverse("word").alias("word")), "spelling-backward")
    nodes = materialize(forward.join(backward.select(F.reverse("word").alias("_back"), F.col("path").alias("back")).hint("merge"), F.col("word") == F.col("_back"))
                        .select("word", F.element_at("path", -1).alias("id"), "n", "path", "back"), "spelling-nodes")
    length = F.size("path") - 1
    # at i: the pair of the cut before letter i, and the pair with letter i skipped
    cut = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.get("path", i).alias("f"), F.get("back", length - i).alias("r"), F.lit(False).alias("skip"), F.lit(False).alias("lead")))
    letters = F.split("word", "")
    skipped = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get("path", i).alias("f"), F.get("back", length - i - 1).alias("r"), F.lit(True).alias("skip"),
        ((i == 0) | (F.get("_letters", i) != F.get("_letters", F.greatest(i - 1, F.lit(0))))).alias("lead")))
    pairs = nodes.withColumn("_letters", letters).select("id", "n", F.explode(F.concat(cut, skipped)).alias("p")).select("id", "n", "p.*")
    groups = pairs.groupBy("f", "r").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "id", "skip", "lead"))).alias("all")).filter(F.size("all") > 1)
    near = groups.select(F.explode(F.transform("all", lambda m: F.struct(
        m["id"].alias("id"), F.filter("all", lambda o: _before(m, o)).alias("near")))).alias("x"))
    near = near.filter(F.size("x.near") > 0).select("x.id", F.size("x.near").alias("c"), F.struct(F.get("x.near", F.lit(0))["less"].alias("less"), F.get("x.near", F.lit(0))["id"].alias("id")).alias("best"))
    found = near.groupBy("id").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))
    return nodes.select("word", "id", "n").join(found.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id"), "left").drop("_id") \
        .withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def forms(near: DataFrame, min_ratio: int = MIN_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``neighbours``: the form is the best neighbour if it is ``min_ratio`` times as frequent or more, the root
    the end of the chain of forms. Each step multiplies the count, so a chain has at most 18 steps and five doublings follow it whole."""
    near = materialize(near.withColumn("to", F.when(-F.col("best.less") >= min_ratio * F.col("n"), F.col("best.id"))), "spelling-near")
    names = near.select(F.col("id").alias("_id"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    ends = materialize(near.filter("to IS NOT NULL").select("id", "to"), "spelling-forms")
    for step in range(5):
        onward = ends.select(F.col("id").alias("_at"), F.col("to").alias("_next"))
        ends = materialize(ends.join(onward.hint("merge"), F.col("to") == F.col("_at"), "left").select("id", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")), f"spelling-roots-{step}")
        if ends.filter("moved").isEmpty():
            break
        ends = ends.drop("moved")
    roots = ends.join(names.hint("merge"), F.col("to") == F.col("_id")).select(F.col("id").alias("_from"), F.col("_word").alias("root"))
    out = near.join(names.hint("merge"), F.col("to") == F.col("_id"), "left").withColumnRenamed("_word", "form").withColumnRenamed("_n", "form_n").drop("_id")
    out = out.join(roots.hint("merge"), F.col("id") == F.col("_from"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, min_ratio: int = MIN_RATIO) -> DataFrame:
    """The whole job over words (one row for each occurrence)."""
    return forms(neighbours(materialize(vocabulary(words, min_letters, min_count), "spelling-words")), min_ratio)


def worn_words(docs: DataFrame, one_in: int = 31, min_letters: int = MIN_LETTERS) -> DataFrame:
    """Every word of ``docs`` (doc_id, text) with ``min_letters`` letters or more, of which about one in ``one_in`` has lost a letter: the crc32 of
    ``doc_id:word`` decides whether, and which. A run of fewer letters can't give such a word."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD}{{{min_letters},}})"))).alias("run"))
    runs = runs.select("_id", ascii_lower(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    worn = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % one_in == 0, worn).otherwise(F.col("run")).alias("word"))
