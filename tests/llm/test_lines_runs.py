"""op4_line_dedup: every later repeated run of MIN_WORDS words goes, whichever earlier document holds it."""
import random

from llm_cases import DOCS
from retrieva.llm import lines, queries


def every_run(docs, min_words=lines.MIN_WORDS):
    """docs: (doc_id, text) -> (text, removed) of each: all runs of lines, of any length, against the first place that holds them."""
    split = [t.split("\n") for _, t in docs]
    strip = [[x.strip() for x in s] for s in split]
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    first, gone = {}, {i: set() for i in range(len(docs))}

    def runs(i):
        words = [len(x.split()) for x in split[i]]
        for s in range(len(words)):
            for e in range(s + 1, len(words) + 1):
                if sum(words[s:e]) >= min_words:
                    yield s, e
    for i in order:
        for s, e in runs(i):
            j, t = first.setdefault(tuple(strip[i][s:e]), (i, s))
            if j != i or s - t >= e - s:
                gone[i] |= set(range(s, e))
    return [("\n".join(x for k, x in enumerate(s) if k not in gone[i]), len(gone[i])) for i, s in enumerate(split)]


def check(spark, docs):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got == dict(zip([i for i, _ in docs], every_run(docs), strict=True))
    return got


def test_op4_longer_run_in_a_later_document(spark, write_tables):
    """Document 1 holds the first line only; the rest of the passage, under MIN_WORDS words, is first held by document 2."""
    passage = ["a " * 55, "b " * 30, "c " * 15]
    docs = [(1, passage[0])] + [(i, "\n".join([*passage, f"own{i} " * 70])) for i in (2, 3, 4)] + [(5, "\n".join(["own5 " * 70, *passage]))]
    got = check(spark, docs)
    assert [got[i][1] for i in range(1, 6)] == [0, 1, 3, 3, 3]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    assert {r.doc_id: r.n_removed for r in queries.op4_line_dedup(spark, write_tables(documents=df)).collect()} == {i: n for i, (_, n) in got.items()}


def test_random_runs_against_every_earlier_document(spark):
    rng = random.Random(11)
    pool = ["w " * n + str(i) for i, n in enumerate([0, 1, 3, 5, 8, 13, 21, 34, 55, 2, 2, 2])] + ["", "  "]
    docs = []
    for i in range(80):
        t = [rng.choice(pool) for _ in range(rng.randint(0, 25))]
        if docs and rng.random() < 0.7:
            s = rng.choice(docs)[1].split("\n")
            a = rng.randrange(len(s))
            t[len(t) // 2:len(t) // 2] = s[a:a + rng.randint(1, 12)]
        docs.append((i, "\n".join(t)))
    check(spark, docs)
