import random

from llm_cases import DOCS
from retrieva.llm import lines, queries


def expect(docs, min_words=lines.MIN_WORDS):
    """docs: (doc_id, text) -> (text, removed) of each: every run of lines that holds min_words words and that an earlier place (id, null first, then line)
    holds as well goes; a run that overlaps its first place in the same text is no repeat. It is enough to look at runs that lose the words when they lose
    a line at one of their ends: longer ones are made of them."""
    split = [(t or "").split("\n") for _, t in docs]
    strip = [[x.strip() for x in s] for s in split]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    first, gone = {}, [set() for _ in docs]

    def runs(i):
        words = [len(x.split()) for x in split[i]]
        for s in range(len(words)):
            held = 0
            for e in range(s + 1, len(words) + 1):
                held += words[e - 1]
                if held >= min_words:
                    yield s, e
                    if held - words[s] >= min_words:
                        break
    for i in order:
        for s, e in runs(i):
            j, t = first.setdefault(tuple(strip[i][s:e]), (i, s))
            if j != i or s - t >= e - s:
                gone[i] |= set(range(s, e))
    return [("\n".join(x for k, x in enumerate(s) if k not in gone[i]) if docs[i][1] is not None else None, len(gone[i])) for i, s in enumerate(split)]


def test_op4_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op4_line_dedup(spark, sf).collect()}
    assert got == dict(zip([i for i, _ in docs], expect(docs)))
    assert sum(n for _, n in got.values()) > 100


def test_random_runs_of_short_lines(spark):
    rng = random.Random(5)
    pool = ["w " * n + str(i) for i, n in enumerate([0, 1, 3, 5, 8, 13, 21, 34, 55, 2, 2, 2])] + [""]
    docs = []
    for i in range(60):
        t = [rng.choice(pool) for _ in range(rng.randint(0, 25))]
        if docs and rng.random() < 0.7:
            s = rng.choice(docs)[1].split("\n")
            a = rng.randrange(len(s))
            t[len(t) // 2:len(t) // 2] = s[a:a + rng.randint(1, 12)]
        docs.append((i * 3, "\n".join(t)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).selectExpr("*", "1 AS runs", "2 AS place", "3 AS start")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got == dict(zip([i for i, _ in docs], expect(docs)))


def test_cases(spark):
    p = "\n".join("p%d " % i + "word " * 20 for i in range(4))
    docs = [(3, p), (1, "start\n" + p + "\nend"), (2, None), (4, ""), (None, p), (5, "\n".join([p] * 3)), (6, "short\nlines")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    want = dict(zip([i for i, _ in docs], expect(docs)))
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == want
    assert got[None].n_removed == 0 and got[1].text == "start\nend" and got[3].text == "" and got[5].n_removed == 12 and got[2].text is None
    twice = lines.dedup_lines(df.unionAll(df.filter("doc_id = 3"))).filter("doc_id = 3").collect()
    assert [r.text for r in twice] == ["", ""]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_blank_and_short_lines_cost_their_number():
    """A window from each of very many blank lines: one pass, not one for each window."""
    import time
    text = "\n" * 200_000 + "word " * 60 + "\n" * 200_000
    t = time.time()
    found = lines.windows_of(text)
    assert time.time() - t < 20 and len(found) > 200_000
    short = lines.windows_of("\n".join(["a"] * 3000))
    assert len(short) == 2951 and {w[1] for w in short} == {50}


def test_windows_equal_their_definition():
    """Minimum, rightmost of equal ones, and hashes that agree exactly where the lines do."""
    import xxhash
    rng = random.Random(9)
    by_content, by_hash = {}, {}
    for _ in range(60):
        t = [rng.choice(["", " ", "a b c", "d e", "f " * 20, "g", "h " * 55]) for _ in range(rng.randint(1, 60))]
        strip = [x.strip() for x in t]
        h = [xxhash.xxh64_intdigest(x.encode()) for x in strip]
        for start, n, fp, beside, whole, _ in lines.windows_of("\n".join(t)):
            assert sum(len(x.split()) for x in t[start:start + n]) >= lines.MIN_WORDS
            assert fp == min(h[start:start + n]) - (1 << 63)
            content = tuple(strip[start:start + n])
            assert by_content.setdefault(content, (fp, beside, whole)) == (fp, beside, whole)
            assert by_hash.setdefault((fp, beside, whole), content) == content
