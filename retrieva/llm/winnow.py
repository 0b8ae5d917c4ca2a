"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a sequence of words (runs of characters that are not ASCII white space). A word of more than LONG characters counts as its runs of PIECE
characters, one from each character on, so that texts without white space have fingerprints too. Each run of K words has a hash; in every
window of W consecutive hashes the smallest is chosen, the rightmost of equal ones, and its position is kept. Two texts that share
W + K - 1 consecutive words share a whole window, so they are guaranteed to share a fingerprint.

Hash and position travel as one number, ``hash * 2**24 + (2**24 - 1 - position)``: its minimum is the smallest hash at the
rightmost position, so a window's choice is one ``least`` of W numbers, and the work on a text is linear. (Positions
wrap after 16.8 million words; only a tie across the wrap would then go to the left.)

Cases: every row has fingerprints, whatever its id; a null text is the empty text and has none; fewer than K words make one hash of all words; fewer than W
hashes make one window; two texts without fingerprints are alike (1.0), one without and one with are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrieva.session import materialize

from .common import ranged

#: Words in a hash, and hashes in a window: matches of 7 words are guaranteed.
K, W = 3, 5
#: Bits of the hash and of the position.
HASH_BITS, POS_BITS = 38, 24
_POS = (1 << POS_BITS) - 1
#: Characters of the longest word that is taken whole, and of the pieces of longer ones.
LONG, PIECE = 32, 8


def words(text: str) -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    whole = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    pieces = F.transform(whole, lambda x: F.when(F.length(x) > LONG, F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{PIECE}}}))."), F.lit(1))).otherwise(F.array(x)))
    return F.when(t.rlike(f"[^\\x20\\x09-\\x0D]{{{LONG + 1}}}"), F.flatten(pieces)).otherwise(whole)


def winnow(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out``: the chosen (hash, position) numbers of ``text`` in order of the windows.

    Each step is a column of its own, used more than once by the next, so that the optimizer doesn't copy it into the loops.
    """
    df = df.withColumn("_h", F.transform(words(text), lambda x: F.xxhash64(x)))
    h, n = F.col("_h"), F.size("_h")
    grams = (F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64("_h")))
             .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))))
    packed = F.transform(grams, lambda g, i: F.pmod(g, F.lit(1 << HASH_BITS)) * (1 << POS_BITS) + (_POS - i.cast("long") % (1 << POS_BITS)))
    df = df.withColumn("_g", packed).drop("_h")
    g, m = F.col("_g"), F.size("_g")
    mins = (F.when(m == 0, F.array().cast("array<bigint>")).when(m <= w, F.array(F.array_min("_g")))
            .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(m - w, F.lit(0))), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))))
    return df.withColumn(out, F.array_distinct(mins)).drop("_g")


def hashes(fp: str) -> Column:
    """Hash of each chosen number."""
    return F.transform(F.col(fp), lambda v: F.shiftright(v, POS_BITS))


def positions(fp: str) -> Column:
    """Word position of each chosen number."""
    return F.transform(F.col(fp), lambda v: _POS - v.bitwiseAND(F.lit(_POS)))


def hash_set(fp: str) -> Column:
    """Distinct hashes, cut to 31 bits, for likeness."""
    return F.array_distinct(F.transform(F.col(fp), lambda v: F.shiftright(v, POS_BITS).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two hash sets."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either).cast("double")


def digest(fp: str) -> Column:
    """A fingerprint as one string: SHA-256 of its numbers, so equal texts have equal strings."""
    return F.sha2(F.array_join(F.transform(F.col(fp), lambda v: v.cast("string")), ","), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(id, hashes, positions) of every document."""
    f = winnow(docs.select(id_col, text_col), text_col, "_fp", k, w)
    return f.select(id_col, hashes("_fp").alias("hashes"), positions("_fp").alias("positions"))


_KEY = ["doc_id", "_th", "_n"]


def _same(a: str, b: str) -> Column:
    """Equal keys of columns named with the prefixes a and b; null ids are equal."""
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}_th") == F.col(f"{b}_th")) & (F.col(f"{a}_n") == F.col(f"{b}_n"))


def _named(prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in _KEY]


def against_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document against an edited text of its own and against the next document (ascending id; after the last, the first).

    In the edited text the last floor(n / 4) characters are replaced by as many of the next document's first (or all).
    Output (doc_id, n_chars, edited, fp, edited_fp, near_edited, near_next), one row for each row of ``docs``. Rows without an id come first; rows that share
    an id are ordered by a hash of their text, so of rows equal in both each is the next of the one before it. A single document is its own next one.

    The order is found on ids, text hashes and lengths alone. The next document's head and hash set then travel to the
    document; texts are dealt once, by their key.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_th", F.xxhash64("text")).withColumn("_n", F.length("text").cast("long"))
    groups = materialize(base.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.lit(1).alias("one")), "winnow-groups")
    repeated = groups.filter("copies > 1").select(*_named("r"), "copies")
    some_repeat = not repeated.isEmpty()
    if some_repeat:  # equal rows are worked on once
        base = base.groupBy(*_KEY).agg(F.first("text").alias("text"))
    placed = materialize(ranged(groups.drop("copies"), [], _KEY, "one", "winnow-order").select(*_KEY, "slot"), "winnow-slots")
    n = placed.count()
    after = placed.select(*_named("x"), F.pmod(F.col("slot") - 1, F.lit(max(n, 1))).alias("slot"))
    wanted = materialize(placed.join(after, "slot").select(*[f"x{c}" for c in _KEY], *_named("p")), "winnow-next")
    quarter = F.floor(F.col("p_n") / 4).cast("int")
    ahead = winnow(base.join(wanted, _same("", "x")), "text", "_fp", k, w)
    ahead = ahead.select(*[f"p{c}" for c in _KEY], F.substring(F.col("text"), F.lit(1), quarter).alias("head"), hash_set("_fp").alias("next_set"))
    own = base.join(ahead, _same("", "p")).select(*_KEY, "text", "head", "next_set", F.lit(1).cast("long").alias("_times"))
    if some_repeat:  # all but the last of equal rows are followed by their own text
        again = base.join(repeated, _same("", "r")).select(*_KEY, "text", F.substring(F.col("text"), F.lit(1), F.floor(F.col("_n") / 4).cast("int")).alias("head"),
                                                           F.lit(None).cast("array<int>").alias("next_set"), (F.col("copies") - 1).alias("_times"))
        own = own.unionByName(again)
    kept = (F.col("_n") - F.floor(F.col("_n") / 4)).cast("int")
    own = own.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("head"))).drop("head")
    own = winnow(winnow(own, "text", "fp", k, w), "edited", "edited_fp", k, w)
    own = own.withColumn("_a", hash_set("fp")).withColumn("_b", hash_set("edited_fp")).withColumn("_c", F.coalesce("next_set", "_a"))
    out = own.select("doc_id", F.col("_n").alias("n_chars"), "edited", "fp", "edited_fp", likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"), "_times")
    return (out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).drop("_copy") if some_repeat else out).drop("_times")
