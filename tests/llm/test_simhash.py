import random

import numpy as np
import pandas as pd
import xxhash

from llm_cases import DOCS
from retrieva.llm import graph, queries, simhash


def brute_fingerprint(text, k=4):
    words, word = [], b""
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if b == 32 or 9 <= b <= 13:
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([b])
    words += [word] * bool(word)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=4):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op1_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_simhash(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    fp = {i: brute_fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    want = brute_components(list(fp), list(fp.values()))
    assert len(got) == len(docs)
    assert {i: f"{v:016x}" for i, v in fp.items()} == dict(zip(got.doc_id, got.fingerprint))
    assert want == dict(zip(got.doc_id, got.component_id))


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        fps = np.array([x, y], dtype=np.uint64).view(np.int64)
        rows, keys, sides = simhash.join_keys(fps)
        left = {k for r, k, s in zip(rows, keys, sides) if r == 0 and s < 2}
        right = {k for r, k, s in zip(rows, keys, sides) if r == 1 and s != 1}
        assert left & right


def test_components_match_brute_force_on_near_random_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = []
    for _ in range(400):
        f = rng.choice(seeds)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << b
        fps.append(f)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}).drop_duplicates())
    nodes = nodes.selectExpr("fp", "fp AS group")
    c = graph.components(simhash._joined(nodes, 4), "t").toPandas()
    got = dict(zip(c.node, c.component))
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    want = brute_components(signed, [s & (1 << 64) - 1 for s in signed])
    assert {s: got.get(s, s) for s in signed} == want


def around(centre, n, rng):
    found = set()
    while len(found) < n:
        f = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << b
        found.add(f)
    return np.array(sorted(found), np.uint64).view(np.int64)


def test_a_linked_group_of_20000_prints_leaves_no_key_to_compare(spark):
    fps = around(random.Random(3).getrandbits(64), 20_000, random.Random(4))
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps})).selectExpr("fp", "1L AS group")
    crowds = simhash._crowded_keys(nodes)
    keys = simhash._keys(nodes)
    assert simhash._split_keys(keys.join(crowds, "key", "left_semi")).isEmpty()
    assert keys.join(crowds, "key", "left_anti").groupBy("key").count().agg({"count": "max"}).first()[0] <= simhash.CROWD
    assert simhash._joined(nodes, 4).isEmpty()


def test_the_largest_group_of_a_key_meets_only_the_others(spark):
    rng = random.Random(6)
    fps = around(rng.getrandbits(64), 1500, rng)
    group = np.array([0 if rng.random() < 0.8 else rng.randint(1, 30) for _ in fps])
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps, "group": group}))
    u = fps.view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    want = {(group[x], group[y]) for x, y in zip(a, b) if group[x] < group[y]}
    got = [(r.a, r.b) for r in simhash._joined(nodes, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not simhash._crowded_keys(nodes).isEmpty()
    keys = simhash._split_keys(simhash._keys(nodes)).toPandas()
    sizes = keys.groupby(["key", "group", "main"]).size().reset_index(name="n")
    assert (sizes.groupby("key")["group"].nunique() > 1).all() and (sizes.groupby("key")["main"].sum() == 1).all()
    assert (sizes[sizes.main].set_index("key")["n"] == sizes.groupby("key")["n"].max()).all()


def test_edges_of_the_input(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "a b c d e f g", "en", "a", 13),
            (4, "a b c d e f g", "en", "a", 13), (5, "A  B c\td e f g", None, "a", 13), (None, "x", "en", None, 1), (7, "word " * 70000, "en", "a", 350000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS `group`")
    got = simhash.near_duplicates(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (7, 7)]
    assert [r.fp for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    c = {r.node: r.component for r in graph.components(edges, "t").collect()}
    assert {c[i] for i in range(301)} == {0} and c[1001] == 1000 and len(c) == 303
