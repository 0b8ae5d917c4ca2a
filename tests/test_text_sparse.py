import math
from collections import Counter

from pyspark.ml.feature import StopWordsRemover

from retrieva.functions.stopwords import ENGLISH_STOP_WORDS
from retrieva.operators import sparse


def test_stop_words_equal_spark_default(spark):
    assert tuple(StopWordsRemover.loadDefaultStopWords("english")) == ENGLISH_STOP_WORDS


def _terms(text):
    import re
    toks = [t for t in re.findall(r"[^\W]{2,}", text.lower()) if t not in ENGLISH_STOP_WORDS]
    out = list(toks)
    for n in (2, 3):
        out += [" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1)]
    return out


def test_tfidf_matches_hand_computation(spark):
    docs = [(1, "Cats chase mice. Cats sleep."), (2, "Dogs chase cats"), (3, "Mice hide; the mice run")]
    df = spark.createDataFrame(docs, "doc_id long, content string")
    ix = sparse.build_tfidf_index(df, max_features=None)
    got = {(r.term, r.doc_id): r.score for r in ix.postings.collect()}
    n = len(docs)
    tfs = {d: Counter(_terms(t)) for d, t in docs}
    dfc = Counter(t for c in tfs.values() for t in c)
    for d, c in tfs.items():
        w = {t: k * (math.log((1 + n) / (1 + dfc[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert abs(got[(t, d)] - v / norm) < 1e-12
    assert len(got) == sum(len(c) for c in tfs.values())
    q = spark.createDataFrame([(7, "cats chase cats"), (8, "zebra")], "query_id long, text string")
    hits = {(r.query_id, r.doc_id): r.score for r in sparse.sparse_search(ix, q).collect()}
    # distinct query terms: cats, chase, cats chase, chase cats, cats chase cats
    for d in (1, 2):
        qt = {"cats", "chase", "cats chase", "chase cats", "cats chase cats"}
        exp = sum(got.get((t, d), 0.0) for t in qt)
        assert abs(hits[(7, d)] - exp) < 1e-12
    assert not any(k[0] == 8 for k in hits)


def test_a_vocabulary_too_large_to_send_gives_the_same_weights(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"alpha{i % 3} beta gamma{i} beta") for i in range(20)], "doc_id long, content string")
    one = {(r.term, r.doc_id): r.score for r in sparse.build_tfidf_index(df, max_features=30).postings.collect()}
    monkeypatch.setattr(sparse, "MAX_SENT_TERMS", 5)
    two = {(r.term, r.doc_id): r.score for r in sparse.build_tfidf_index(df, max_features=30).postings.collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one) and len(one) > 60


def test_vocabulary_cap_ties_by_term(spark):
    df = spark.createDataFrame([(1, "bb aa cc"), (2, "aa bb")], "doc_id long, content string")
    ix = sparse.build_tfidf_index(df, max_features=2, ngram_range=(1, 1))
    assert sorted(r.term for r in ix.vocab.collect()) == ["aa", "bb"]


def _bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = [d.split() for d in docs]
    n = len(toks)
    avgdl = sum(map(len, toks)) / n
    df = Counter(t for d in toks for t in set(d))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (eps * mean if v < 0 else v) for t, v in idf.items()}
    out = []
    for d in toks:
        c = Counter(d)
        s = 0.0
        for q in query.split():
            tf = c.get(q, 0)
            s += idf.get(q, 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avgdl))
        out.append(s)
    return out


def test_bm25_matches_reference_formula(spark):
    docs = ["the cat sat", "the dog sat down", "a cat and a dog", "the end"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string")
    ix = sparse.build_bm25_index(df)
    q = spark.createDataFrame([(0, "the cat cat"), (1, "dog")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in sparse.bm25_search(ix, q).collect()}
    for qid, text in [(0, "the cat cat"), (1, "dog")]:
        exp = _bm25(docs, text)
        for d, v in enumerate(exp):
            assert abs(got.get((qid, d), 0.0) - v) < 1e-9
    # "the" is in 3 of 4 documents: its raw idf is negative and gets replaced
    assert got[(0, 0)] > 0
    top = sparse.bm25_top(sparse.bm25_search(ix, q), 4).collect()
    assert all(r.score > 0 for r in top)


def test_rank_all_equals_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from retrieva.operators.topk import rank_all
    rows = [(q, d, float((d * 7 + q) % 5)) for q in range(3) for d in range(50)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double").repartition(5)
    order = [F.desc("score"), F.asc("doc_id")]
    a = {(r.query_id, r.doc_id): r["rank"] for r in rank_all(df, "query_id", order).collect()}
    w = Window.partitionBy("query_id").orderBy(*order)
    b = {(r.query_id, r.doc_id): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert a == b


def test_rounding_equals_sparks(spark):
    from pyspark.sql import functions as F

    from retrieva.operators.topk import ranked_score
    halves = [k / 1e6 + 0.5e-6 for k in range(-300, 300)] + [float(f"{k / 1e6 + 0.0000005:.7f}") for k in range(0, 999_000, 997)]
    rows = halves + [math.nextafter(x, s) for x in halves for s in (-1e9, 1e9)] + [math.sin(i) * 10 ** (i % 9 - 4) for i in range(3000)]
    rows += [0.0, -0.0, -1e-9, 1e300, -1e18, 999.9999995, 1000.0000005, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(x,) for x in rows], "x double").select("x", ranked_score("x").alias("a"), F.round("x", 6).alias("b"))
    assert df.filter("NOT (a <=> b)").count() == 0 and df.filter("a IS NULL").count() == 1


def test_strip_looks_at_the_ends(spark):
    from pyspark.sql import functions as F

    from retrieva.functions.text import SPACE, strip_ws
    rows = [chr(c) + "a" + chr(c) + "b" + chr(c) * 2 for c in [*range(1, 0x3100), 0xfeff, 0x1f600] if not 0xd800 <= c < 0xe000] + ["", " ", "\n\u3000", None, "a"]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select("x", strip_ws("x").alias("a"), F.regexp_replace("x", f"^[{SPACE}]+|[{SPACE}]+$", "").alias("b"))
    assert df.filter("NOT (a <=> b)").count() == 0 and "regexp_replace" not in df.select("a")._jdf.queryExecution().executedPlan().toString()


def _counted(kept, low, high):
    df, ctf = Counter(), Counter()
    for words in kept:
        terms = [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
        ctf.update(terms)
        df.update(set(terms))
    return df, ctf


def test_capped_vocabulary_without_counting_every_term(spark, monkeypatch):
    """Terms of two and three words are counted only if their parts are frequent; the vocabulary and the weights are those of all counts."""
    import random
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["éa", "zz"]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(0, 40))) for _ in range(120)] + [None, "", "once more w0 w1 w0 w1"]
    docs = spark.createDataFrame([(i % 100 if i else None, t) for i, t in enumerate(texts)], "doc_id long, content string")
    rows = [(t or "").split() for t in texts]
    counted = []
    whole = sparse._gram_counts

    def gram_counts(codes, grams, n):
        out = whole(codes, grams, n)
        counted.append(out.count())
        return out
    monkeypatch.setattr(sparse, "_gram_counts", gram_counts)
    for name, n in (("SLICE_ROWS", 7), ("MAX_GRAMS", 20), ("MAX_COUNTED", 8)):
        monkeypatch.setattr(sparse, name, n)
    for low, high, most in ((1, 3, 40), (1, 3, 7), (1, 2, 500), (2, 3, 50), (1, 3, 100_000), (1, 1, 10)):
        counted.clear()
        df, ctf = _counted(rows, low, high)
        want = sorted(ctf, key=lambda t: (-ctf[t], t))[:most]
        ix = sparse.build_tfidf_index(docs, max_features=most, stop_words=(), ngram_range=(low, high))
        assert {(r.term, r.df, r.ctf) for r in ix.vocab.collect()} == {(t, df[t], ctf[t]) for t in want}
        if (low, most) == (1, 40):
            assert len(counted) == 2 and sum(counted) < 0.5 * len([t for t in ctf if " " in t])
        known = set(want)
        expect = []
        for i, words in enumerate(rows):
            tf = Counter(t for n in range(low, high + 1) for t in (" ".join(words[j:j + n]) for j in range(len(words) - n + 1)) if t in known)
            w = {t: k * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, k in tf.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            expect += [(t, i % 100 if i else None, round(x / norm, 9)) for t, x in w.items()]
        assert Counter((r.term, r.doc_id, round(r.score, 9)) for r in ix.postings.collect()) == Counter(expect)
    monkeypatch.setattr(sparse, "MAX_SENT_TERMS", 5)  # too many to send: all terms are counted, as before
    assert {(r.term, r.ctf) for r in sparse.build_tfidf_index(docs, max_features=7, stop_words=()).vocab.collect()} == {(t, _counted(rows, 1, 3)[1][t]) for t in sorted(_counted(rows, 1, 3)[1], key=lambda t: (-_counted(rows, 1, 3)[1][t], t))[:7]}
