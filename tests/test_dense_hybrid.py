import numpy as np
from pyspark.sql import functions as F

from retrieva.operators import dense, hybrid


def _vecs(spark, rows, idc, vc):
    return spark.createDataFrame(rows, f"{idc} long, {vc} array<float>")


def test_fewer_documents_than_k_and_ties(spark):
    q = _vecs(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id", "qvec")
    d = _vecs(spark, [(10, [0.5, 0.5]), (11, [0.5, 0.5]), (12, [0.0, 1.0])], "doc_id", "dvec")
    got = dense.knn(q, d, k=5).orderBy("query_id", "rank").collect()
    q1 = [(r.doc_id, r.score) for r in got if r.query_id == 1]
    assert [x[0] for x in q1] == [10, 11, 12]          # equal scores: lower id first
    assert len(q1) == 3                                 # no invented hits
    q2 = [r for r in got if r.query_id == 2]
    assert [r.doc_id for r in q2] == [10, 11, 12] and all(r.score == 0 for r in q2)  # zero vector


def test_blocked_search_equals_numpy(spark):
    rng = np.random.default_rng(3)
    qs = rng.normal(size=(7, 8)).astype(np.float32)
    ds = rng.normal(size=(120, 8)).astype(np.float32)
    q = _vecs(spark, [(i, v.tolist()) for i, v in enumerate(qs)], "query_id", "qvec")
    d = _vecs(spark, [(i, v.tolist()) for i, v in enumerate(ds)], "doc_id", "dvec")
    got = dense.knn(q, d, k=4, doc_block=17, query_block=3).collect()  # many blocks
    s = qs.astype(np.float64) @ ds.astype(np.float64).T
    for i in range(7):
        exp = list(np.argsort(-s[i], kind="stable")[:4])
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == exp
    l2 = dense.knn(q, d, k=3, metric="l2", doc_block=50).collect()
    dist = ((qs[:, None, :].astype(np.float64) - ds[None].astype(np.float64)) ** 2).sum(-1)
    for i in range(7):
        exp = list(np.argsort(dist[i], kind="stable")[:3])
        assert [r.doc_id for r in sorted((r for r in l2 if r.query_id == i), key=lambda r: r.rank)] == exp


def test_ivf_all_cells_equals_flat_and_small_nlist(spark):
    rng = np.random.default_rng(5)
    ds = rng.normal(size=(60, 6))
    ds /= np.linalg.norm(ds, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ds)], "doc_id long, dvec array<double>")
    q = spark.createDataFrame([(i, ds[i * 7].tolist()) for i in range(5)], "query_id long, qvec array<double>")
    nlist = dense.nlist_for(60)
    cents = dense.fixed_centroids(d, nlist)
    assigned = dense.assign_cells(d, cents)
    ivf = {(r.query_id, r.doc_id, r["rank"]) for r in dense.ivf_search(q, assigned, cents, k=5, nprobe=nlist).collect()}
    flat = {(r.query_id, r.doc_id, r["rank"]) for r in dense.knn(q, d, k=5).collect()}
    assert ivf == flat
    assert dense.nlist_for(7) == 1                      # fewer than 10 vectors: one cell


def test_equal_scores_give_k_rows_for_each_block(spark):
    q = _vecs(spark, [(i, [0.0, 0.0]) for i in range(5)], "query_id", "qvec")
    d = _vecs(spark, [(i, [0.0, 0.0]) for i in range(5000)], "doc_id", "dvec")
    for metric in ("ip", "l2"):
        cand = dense.knn_candidates(q, d, 5, metric, doc_block=1000)
        assert cand.count() == 5 * 5 * 5
        assert {r.doc_id for r in dense.knn(q, d, 5, metric, doc_block=1000).collect()} == set(range(5))


def test_distances_as_similarities(spark):
    h = spark.createDataFrame([(1, 1, 3.0)], "query_id long, doc_id long, score double")
    assert dense.to_similarity(h).first().score == -3.0 and dense.to_similarity(h, "inverse").first().score == 0.25


def test_the_cut_of_sparse_hits_is_exact_with_negative_dense_scores(spark):
    rng = np.random.default_rng(4)
    sp = [(q, d, float(rng.integers(1, 40)) / 7) for q in range(6) for d in range(60) if rng.random() < 0.7]
    dn = [(q, int(d), float(s)) for q in range(6) for d, s in zip(rng.choice(60, 5, replace=False), rng.normal(size=5) - 0.5)]
    schema = "query_id long, doc_id long, score double"
    sp, dn = spark.createDataFrame(sp, schema), spark.createDataFrame(dn, schema)
    for alpha in (0.0, 0.3, 0.5, 1.0):
        for k in (1, 5):
            top = dn.filter("true") if k == 5 else dense.top_k(dn, "query_id", [F.desc("score")], 1).drop("rank")
            got = sorted(map(tuple, hybrid.hybrid_top_k(top, sp, k, alpha).select("query_id", "doc_id", "rank").collect()))
            order = [F.desc(F.round("combined_score", 6)), F.asc("doc_id")]
            want = dense.top_k(hybrid.fuse_scores(top, sp, alpha), "query_id", order, k).select("query_id", "doc_id", "rank")
            assert got == sorted(map(tuple, want.collect()))


def test_hybrid_alpha_extremes(spark):
    dn = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 12, 0.5)], "query_id long, doc_id long, score double")
    sp = spark.createDataFrame([(1, 11, 2.0), (1, 13, 4.0)], "query_id long, doc_id long, score double")
    a0 = hybrid.hybrid_top_k(dn, sp, k=5, alpha=0.0).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in a0 if r.query_id == 1][:2] == [13, 11]        # sparse order
    a1 = hybrid.hybrid_top_k(dn, sp, k=5, alpha=1.0).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in a1 if r.query_id == 1][:2] == [10, 11]        # dense order
    # question 2 has no sparse hit: dense only; no question without any hit appears
    mid = hybrid.hybrid_top_k(dn, sp, k=5, alpha=0.5).collect()
    q2 = [r for r in mid if r.query_id == 2]
    assert len(q2) == 1 and abs(q2[0].combined_score - 0.25) < 1e-12
    r13 = [r for r in mid if r.doc_id == 13][0]
    assert abs(r13.combined_score - 0.5) < 1e-12                             # no dense hit: 0 + 0.5 * 4/4
