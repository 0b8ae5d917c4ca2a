import numpy as np
import pytest

from retrieva.llm import forest, queries


def brute(ids, vectors, limit=0.9):
    units = [None if v is None or any(x is None for x in v) else forest.unit(np.asarray(v, "<f8").tobytes()) for v in vectors]
    root, n = list(range(len(ids))), [0] * len(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and (units[i] @ units[j] >= limit or vectors[i] == vectors[j]):
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [(ids[i], n[i], least[find(i)], ids[i] is not None and ids[i] == least[find(i)]) for i in range(len(ids))]


def test_op6_equals_brute_force(spark, write_tables):
    """The given vectors, and for some of them exact, near and opposite copies."""
    rng = np.random.default_rng(2)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [list(r.embedding) for r in given]
    for i in range(0, 400, 2):
        v = np.array(vectors[i], np.float32)
        noise = rng.standard_normal(len(v)).astype(np.float32) * np.float32([0, 0.005, 0.03, 0.05, 0.06][i // 2 % 5])
        vectors += [(v + noise).tolist(), (-v).tolist(), vectors[0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int")
    x = np.array(vectors, np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    n = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in queries.op6_embedding_dedup(spark, write_tables(embeddings=df)).collect()}
    assert len(got) == len(vectors) and n.sum() > 40000 and n.max() >= 200
    assert all(got[i].n_links <= n[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.99 * n.sum()
    assert sum(got[i].n_links == n[i] for i in got) >= 0.98 * len(got)


def near_pairs(rng, n, dim, cos):
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return np.vstack([a, cos * a + np.sqrt(1 - cos * cos) * b])


@pytest.mark.parametrize("settings", [{}, {"sample": 64, "large": 100, "leaf": 50}])
def test_recall_at_the_limit(spark, settings):
    """Pairs just above the limit are the hardest: at least 0.9 of them are found, also when leaves are split further."""
    rng = np.random.default_rng(1)
    x = near_pairs(rng, 600, 64, 0.91)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = forest.near_duplicates(df, **settings).collect()
    assert sum(r.n_links > 0 for r in got) >= 0.9 * len(x)
    assert all(r.component_id == (r.vec_id % 600 if r.n_links else r.vec_id) for r in got)


def test_blocks_of_a_leaf_that_cannot_be_split(spark):
    """Multiples of one vector have equal projections: one leaf, compared in blocks, with every link."""
    v = np.array([1.0, 2.0, -1.0, 0.5])
    df = spark.createDataFrame([(i, (v * 2.0**(i % 90 - 45)).tolist()) for i in range(180)], "vec_id bigint, embedding array<double>")
    got = forest.near_duplicates(df, leaf=8, large=16, block=20, sample=64).collect()
    assert {r.component_id for r in got} == {0} and {r.n_links for r in got} == {179} and sum(r.kept for r in got) == 1


def test_cases(spark):
    a, b = [1.0, 0.0, 0.0], [0.95, 0.1, 0.0]
    vectors = [a, a, b, None, [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [], [1.0, 0.0], [2.0, 0.0], [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0], a, [1e300, 0.0, 0.0]]
    ids = [5, 2, 9, 1, 3, 4, 6, 7, 8, 10, 11, 12, 13, None, 2**60 + 1]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS k", "2 AS raw", "3 AS leaf")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute(ids, vectors), key=key)
    assert forest.near_duplicates(df.limit(0)).count() == 0
