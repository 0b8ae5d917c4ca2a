"""op13_periodic against brute force; tiles of any size give the same runs."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from llm_cases import DOCS
from retrieva.llm import periodic, queries


def brute_runs(w, min_length=12):
    """Every run, by comparing all words q apart for every q."""
    out, n = [], len(w)
    codes = np.array([{x: i for i, x in enumerate(dict.fromkeys(w))}[x] for x in w]) if n < 200 else np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1]
    for q in range(1, n // 2 + 1):
        eq = np.flatnonzero(np.diff(np.concatenate(([0], (codes[q:] == codes[:-q]).astype(np.int8), [0]))))
        for x, y in zip(eq[::2].tolist(), (eq[1::2] + q).tolist(), strict=True):
            if y - x >= max(min_length, 2 * q) and not any(q % d == 0 and (codes[x:y - d] == codes[x + d:y]).all() for d in range(1, q)):
                out.append((x, y - x, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(i, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def brute(i, text):
    w = planted(i, text)
    runs = brute_runs(w)
    gone = {k for x, n, q in runs for k in range(x + q, x + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{x},{n},{q}\n" for x, n, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *(best or (None, None, None)), best[1] * 1000 // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())


def values(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_op13_equals_brute_force(spark, sf001):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    got = queries.op13_periodic(spark, sf001).collect()
    assert len(got) == len(docs)
    bad = [r.doc_id for r in got if values(r) != brute(r.doc_id, docs[r.doc_id])]
    assert not bad
    assert sum(r.n_runs > 0 for r in got) > 10


def hard_texts():
    rng = random.Random(2)
    out = []
    for k in range(120):
        w = []
        while len(w) < rng.choice([0, 5, 30, 200, 700]):
            root = [rng.choice("abcde" if k % 2 else [f"w{x}" for x in range(40)]) for _ in range(rng.randint(1, rng.choice([2, 8, 20, 90])))]
            w += root * rng.randint(1, 7) + root[:rng.randint(0, len(root))]
        out.append(w)
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    return out + [list(fib[-1]), ["x"] * 1000, list("abcabdabcabdabcabd"), list("ab" * 300 + "c" + "ab" * 300)]


@pytest.mark.parametrize("tile", [96, 256, 8192])
def test_tiles_of_any_size(tile):
    """The tiles of a text, solved one by one and put together as the job does it."""
    for w in hard_texts():
        s = periodic.numbered([x.encode() for x in w])
        parts = {(x + at, y + at, q) for at, low, high, t in periodic.tiles_of(s, tile) for x, y, q in periodic.solve_tile(t, low, high)}
        runs = {}
        for x, y, q in sorted(parts, key=lambda r: (r[2], r[0], r[1])):
            mine = runs.setdefault(q, [])
            if mine and x + q <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], y)
            else:
                mine.append([x, y])
        got = sorted(((x, y - x, q) for q, m in runs.items() for x, y in m), key=lambda r: (r[0], r[2]))
        assert got == brute_runs(w), w


def test_job_with_small_tiles_and_cases(spark):
    texts = [" ".join(w) for w in hard_texts()] + [None, "", " \t\n", "one", "é\x0bé\x1cé é " * 20, "x " * 3000, " \n".join(["a b c d e f g h i j k l m n o p q r s t"] * 40)]
    rows = [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[-5:], DOCS).selectExpr("*", "1 AS start", "2 AS _hash", "3 AS body", "4 AS runs")
    for tile in (128, periodic.TILE):
        got = sorted(repr((r.doc_id, *values(r))) for r in periodic.digests(periodic.periodic_runs(periodic.with_repeats(df), tile)).collect())
        assert got == sorted(repr((r[0], *brute(r[0], r[1]))) for r in rows + rows[-5:])
    assert periodic.digests(periodic.periodic_runs(periodic.with_repeats(df.limit(0)))).count() == 0


def test_one_long_text(spark):
    """A text of 300,000 words: a run over most of it, and one inside a single word repeated 100,000 times."""
    rng = random.Random(5)
    w = [str(rng.random()) for _ in range(50_000)]
    text = w[:20_000] + w[20_000:] * 4 + ["same"] * 100_000 + w[:20_000]
    got = periodic.digests(periodic.periodic_runs(spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string"))).collect()
    # the first 20,000 words repeat at the end, over two periods apart or not: only these two are runs
    assert [(r.n_runs, r.start, r.length, r.period) for r in got] == [(2, 20_000, 120_000, 30_000)]
