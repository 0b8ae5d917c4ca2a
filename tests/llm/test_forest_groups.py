"""op6_embedding_dedup: groups of thousands of distinct near copies have every link."""
import numpy as np
import pytest

from retrieva.llm import forest


def grouped(rng, n, groups, dim=64):
    """n random vectors and groups (size, cosine with the centre), shuffled."""
    x = [rng.standard_normal((n, dim))]
    for size, cos in groups:
        c, e = rng.standard_normal(dim), rng.standard_normal((size, dim))
        c /= np.linalg.norm(c)
        e -= (e @ c)[:, None] * c
        x.append(cos * c + np.sqrt(1 - cos * cos) * e / np.linalg.norm(e, axis=1, keepdims=True))
    x = np.vstack(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x[rng.permutation(len(x))]


def links_of(x, limit=0.9):
    return np.concatenate([(x[i:i + 1000] @ x.T >= limit).sum(1) - 1 for i in range(0, len(x), 1000)])


def found(spark, x, **settings):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = sorted(forest.near_duplicates(df, **settings).collect())
    return np.array([r.n_links for r in rows]), [r.component_id for r in rows]


def test_op6_large_groups(spark):
    """A third of the rows in one group at the limit (mean cosine 0.903), another tight one, and background."""
    x = grouped(np.random.default_rng(3), 5000, [(3000, 0.95), (1000, 0.99)])
    want = links_of(x)
    n, component = found(spark, x)
    assert want.max() > 1500 and (n <= want).all() and n.sum() >= 0.999 * want.sum()
    assert len(set(component)) <= (want == 0).sum() + 3


@pytest.mark.parametrize("dim", [3, 16])
def test_cores_are_exact(dim):
    """Every class that links with a core of a centre is in that centre's reach."""
    rng = np.random.default_rng(dim)
    x = grouped(rng, 1500, [(200, 0.97), (200, 0.93), (50, 0.9)], dim)
    centres = forest.dense_centres(x[::3], 0.9)
    home, reach = forest.near_centres(x, centres, np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)), 0.9)
    a, b = np.nonzero(x @ x.T >= 0.9)
    core = home[a] >= 0
    assert core.sum() > 1000 and reach[b[core], home[a[core]]].all()


def test_dense_leaf_is_not_split(spark):
    """A group too thin in the sample to have a centre stays whole when large leaves are split."""
    x = grouped(np.random.default_rng(4), 300, [(700, 0.96)])
    want = links_of(x)
    n, _ = found(spark, x, sample=8, large=200, leaf=50)
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum()
