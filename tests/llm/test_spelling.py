"""op12_spelling against brute force on the words of a table, and cases."""
import random
import re
import zlib
from collections import Counter

from llm_cases import DOCS
from retrieva.llm import queries, spelling

LETTERS = "[A-Za-zÀ-ÿ]+"


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall(LETTERS, text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_skip = {}
    for w in words:
        for i in range(len(w)):
            by_skip.setdefault((w[:i], w[i + 1:]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), group in by_skip.items():
        whole = {a + b} & set(words)
        for w in group:
            near[w] |= (group | whole) - {w}
        for w in whole:
            near[w] |= group
    form = {}
    for w, other in near.items():
        best = min(other, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows(df):
    got = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_op12_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    got = rows(queries.op12_spelling(spark, sf))
    assert got == want
    assert len(want) > 500 and sum(v[0] is not None for v in want.values()) > 20


def test_random_words_of_few_letters(spark):
    """Many neighbours, repeated letters, words that are prefixes of others, chains of forms, paths across partitions."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aab") for _ in range(rng.randint(7, 10))) for _ in range(300)]
    words += ["longword" * 40 + x for x in ("", "a", "ab", "b")] + ["ÀàÿÿÀàÿx", "Ààÿÿàÿx", "ééééééé", "éééééééé"]
    docs = [(i % 50 if i % 7 else None, ", ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, "chained " * 1200 + "chaind " * 0) for i in range(1)] + [(2000, "chainedd " * 60 + "chaineddd " * 3), (2001, None), (2002, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).selectExpr("*", "1 AS word", "2 AS n", "3 AS path", "4 AS run")
    got = rows(spelling.variants(spelling.worn_words(df)))
    assert got == brute(docs)
    assert got["chaineddd"][:2] == ("chainedd", "chained")


def test_numbers_of_nodes_are_the_trie(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    got = {r.word: r.path for r in spelling.number_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "test-nodes").collect()}
    node = {}
    for w in words:
        assert len(got[w]) == len(w) + 1
        for i, x in enumerate(got[w]):
            assert node.setdefault(w[:i], x) == x
    assert len(set(node.values())) == len(node)
    ends = [got[w][-1] for w in words]
    assert ends == sorted(ends)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.variants(spelling.worn_words(empty)).count() == 0
    once = spark.createDataFrame([(1, "nothing repeats herein", None, None, None), (2, None, None, None, None)], DOCS)
    assert spelling.variants(spelling.worn_words(once)).count() == 0
