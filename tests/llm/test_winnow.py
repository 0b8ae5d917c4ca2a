import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from llm_cases import DOCS
from retrieva.llm import queries, winnow


def chain(values):
    """Spark's xxhash64 of several longs: each is hashed with the hash before it as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def brute(text, k=winnow.K, w=winnow.W):
    words = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    words = [p for x in words for p in ([x] if len(x) <= winnow.LONG else [x[i:i + winnow.PIECE] for i in range(len(x) - winnow.PIECE + 1)])]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words]
    grams = [chain(h[i:i + k]) % (1 << winnow.HASH_BITS) for i in range(max(1, len(h) - k + 1))] if h else []
    out = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = grams[i:i + w]
        least = min(window)
        at = i + max(j for j, g in enumerate(window) if g == least)
        if (least, at) not in out:
            out.append((least, at))
    return out


def alike(a, b):
    a, b = {x & (1 << 31) - 1 for x, _ in a}, {x & (1 << 31) - 1 for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op10_equals_brute_force(spark, sf001):
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, sf001).collect()}
    docs = sorted((d.doc_id, d.text or "") for d in spark.read.parquet(f"{sf001}/documents.parquet").collect())
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        m = len(text) // 4
        edited = text[:len(text) - m] + after[:m]
        g = got[i]
        own, other = brute(text), brute(edited)
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for name, fp in (("fingerprint", own), ("edited_fingerprint", other)):
            numbers = ",".join(str(h * 2**24 + 2**24 - 1 - at) for h, at in fp)
            assert g[name] == hashlib.sha256(numbers.encode()).hexdigest()
        assert abs(g.near_edited - alike(own, other)) < 1e-12 and abs(g.near_next - alike(own, brute(after))) < 1e-12


def test_rightmost_ties_short_texts_and_guarantee(spark):
    texts = ["", None, "one", "a a a a a a a a a a a", "a b", " \t ", "p q r s t u v w x y z", "1 2 p q r s t u v 3 4"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    out = {r.doc_id: list(zip(r.hashes, r.positions)) for r in winnow.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: brute(t) for i, t in enumerate(texts)} == out
    assert [p for _, p in out[3]] == [4, 5, 6, 7, 8]
    assert {h for h, _ in out[6]} & {h for h, _ in out[7]}


def by_brute_force(rows):
    """(doc_id, n_chars, edited, near_edited, near_next) of rows (doc_id, text): null ids first, rows of one id by the hash of their text."""
    def place(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h
    docs = [(i, t or "") for i, t in sorted(rows, key=place)]
    out = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        m = len(text) // 4
        edited = text[:len(text) - m] + after[:m]
        out.append((i, len(text), edited, round(alike(brute(text), brute(edited)), 9), round(alike(brute(text), brute(after)), 9)))
    return sorted(out, key=repr)


def test_every_row_has_a_place(spark):
    """Null ids, shared ids and repeated rows: no row is left out."""
    rows = [(5, "abcdefgh"), (1, "x" * 9), (5, "zz"), (None, "no id"), (9, None), (None, "no id"), (None, "other one"), (5, "zz"), (5, "zz"), (7, "one two three four five " * 9),
            (7, "one two three four five " * 8), (8, "a " * 40), (8, "a " * 40), (3, ""), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = winnow.against_next(df.withColumn("slot", F.lit(1)).withColumn("copies", F.lit(2))).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=repr) == by_brute_force(rows)
    assert winnow.against_next(spark.createDataFrame([], DOCS)).count() == 0
    one = winnow.against_next(df.limit(1)).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcdefab", 1.0)]


def test_texts_without_white_space(spark):
    """4,000 letters, the last quarter replaced: most of the fingerprint stays; an inserted letter moves little."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij漢字é") for _ in range(4000))
    rows = [(1, text), (2, "".join(rng.choice("abcdefghij漢字é") for _ in range(3000))), (3, text[:500] + "Z" + text[500:])]
    got = {r.doc_id: r for r in winnow.against_next(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).collect()}
    assert sorted([(r.doc_id, r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.values()], key=repr) == by_brute_force(rows)
    assert 0.5 < got[1].near_edited < 0.8 and got[3].near_next > 0.95 and got[1].near_next < 0.05
