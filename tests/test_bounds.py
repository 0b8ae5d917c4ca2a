"""Searches that stop early by exact bounds give the rows of the full searches; cells in two levels."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from retrieva.operators import dense, sparse
from retrieva.sources import io


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    weight = 1 / np.arange(1, 401)
    weight /= weight.sum()
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=weight)) + (" rare" if i in (7, 70, 700) else "")) for i in range(1500)]
    q = [(i, " ".join(rng.choice(words, 6))) for i in range(30)] + [(100, "rare w0 w0"), (101, "unknown"), (102, ""), (103, None), (104, "w0"), (105, "rare")]
    return spark.createDataFrame(rows, "doc_id long, content string"), spark.createDataFrame(q, "query_id long, text string")


def test_bm25_blocks_give_the_rows_of_the_full_search(spark, texts, tmp_path):
    docs, q = texts
    built = sparse.build_bm25_index(docs)
    io.save_index(str(tmp_path / "b"), built, rows_per_part=3000)
    index = io.load_index(spark, str(tmp_path / "b"))
    assert index.blocks is not None
    for k in (1, 4, 50):
        want = ranked(sparse.bm25_top(sparse.bm25_search(built, q), k))
        top, counts = sparse.bm25_top_blocks(index, q, k)
        assert ranked(top) == want
    top, counts = sparse.bm25_top_blocks(index, q, 4)
    seen = counts.agg(F.sum("blocks").alias("b"), F.sum("scored").alias("s")).first()
    assert seen.s < seen.b
    finer = sparse.bm25_top_blocks(built, q, 4, block_docs=4)[1].agg(F.sum("blocks").alias("b"), F.sum("scored").alias("s")).first()
    assert finer.s < 0.8 * finer.b  # smaller blocks, closer bounds
    # without saved bounds, and with blocks of another size
    assert ranked(sparse.bm25_top_blocks(built, q, 4, block_docs=16)[0]) == ranked(top)


def test_bm25_blocks_with_negative_and_zero_idf(spark):
    docs = spark.createDataFrame([(i, "all all" if i % 2 else "all some") for i in range(40)] + [(40, None)], "doc_id long, content string")
    q = spark.createDataFrame([(1, "all"), (2, "some all"), (3, "some")], "query_id long, text string")
    index = sparse.build_bm25_index(docs)
    assert ranked(sparse.bm25_top_blocks(index, q, 4, block_docs=4)[0]) == ranked(sparse.bm25_top(sparse.bm25_search(index, q), 4))
    empty = sparse.build_bm25_index(docs.limit(0))
    assert sparse.bm25_top_blocks(empty, q, 4)[0].count() == 0 and sparse.bm25_top_blocks(index, q.limit(0), 4)[0].count() == 0


def test_bm25_blocks_move_postings_and_pairs_only(spark, texts, tmp_path, monkeypatch):
    """The saved bounds are made without a shuffle, in several pieces; no (query, document) row is shuffled, and null query and document ids keep their hits."""
    docs, q = texts
    docs = docs.unionByName(spark.createDataFrame([(None, "w0 rare w1")], docs.schema))
    q = q.unionByName(spark.createDataFrame([(None, "w0 rare w2")], q.schema))
    monkeypatch.setattr(sparse, "BOUND_ROWS", 50)
    monkeypatch.setattr(sparse, "SCORE_BLOCK", 16)
    built = sparse.build_bm25_index(docs)
    plan = sparse.block_bounds(built)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Exchange hashpartitioning" not in plan
    io.save_index(str(tmp_path / "b"), built, rows_per_part=3000)
    index = io.load_index(spark, str(tmp_path / "b"))
    most = index.postings.withColumn("block", index.block()).groupBy("term", "block").agg(F.max(index.gain()).alias("m"))
    saved = index.blocks.groupBy("term", "block").agg(F.max("most").alias("s"))
    assert most.join(saved, ["term", "block"], "full_outer").filter("NOT (abs(m - s) < 1e-12) OR m IS NULL OR s IS NULL").isEmpty()
    assert index.blocks.count() > most.count()  # pieces
    top, _ = sparse.bm25_top_blocks(index, q, 4)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan and "SortMergeJoin" not in plan
    key = lambda df: sorted(((r.query_id or -1, r["rank"], r.doc_id or -1, round(r.score, 6)) for r in df.collect()))
    want = key(sparse.bm25_top(sparse.bm25_search(built, q, first=4), 4))
    assert key(top) == want and -1 in {r[0] for r in want} and -1 in {r[2] for r in want}
    monkeypatch.setattr(sparse, "MAX_SENT_QUERY_TERMS", 5)  # terms that aren't sent
    assert key(sparse.bm25_top_blocks(index, q, 4)[0]) == want


def test_term_ranges_bound_every_part(spark):
    stats = spark.createDataFrame([(f"t{i:03d}", 1 + i % 7) for i in range(300)] + [("hot", 1000)], "term string, df long")
    r = sparse.term_ranges(stats, 50)
    held = {}
    for t, df in ((x.term, x.df) for x in stats.collect()):
        at, n = r.locate(t)
        held[at] = held.get(at, 0) + -(-df // n)
    assert max(held.values()) <= 50 and r.locate("hot")[1] == 20 and r.locate("aaa") == (0, 0) and r.first == sorted(r.first)


@pytest.mark.parametrize("unit", [True, False])
def test_exact_cell_search_has_full_recall(spark, unit):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 8)) * 4
    x = centers[rng.integers(0, 20, 1200)] + rng.normal(size=(1200, 8)) * 0.3
    x[5] = 0
    if unit:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, dvec array<double>")
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.vstack([rng.normal(size=(15, 8)), x[:15], np.zeros((1, 8))]))], "query_id long, qvec array<double>")
    cents = dense.train_centroids(v, 24, seed=4)
    at = dense.assign_cells(v, cents)
    bounds = dense.cell_bounds(at, cents)
    for k in (1, 5, 2000):
        hits, probed = dense.ivf_search_exact(q, at, bounds, k)
        assert ranked(hits) == ranked(dense.knn(q, v, k))
    hits, probed = dense.ivf_search_exact(q, at, bounds, 5)
    assert dense.recall_at_k(hits, dense.knn(q, v, 5)).first().recall == 1.0
    share = probed.agg((F.sum("probed") / F.sum("cells")).alias("s")).first().s
    assert share < (0.6 if unit else 0.9)
    assert dense.ivf_search_exact(q, at.limit(0), bounds.limit(0), 5)[0].count() == 0


def test_two_levels_of_cells_beyond_the_limit(spark, monkeypatch):
    """More cells than MAX_CELLS; the fine centroids never go to the tasks as a whole."""
    monkeypatch.setattr(dense, "MAX_CELLS", 12)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, dvec array<double>")
    with pytest.raises(ValueError):
        dense.train_centroids(v, 60)
    top, fine = dense.train_two_level(v, 6, 10, sample=400, sample_per_cell=60)
    cells = fine.collect()
    assert len(cells) > 2 * dense.MAX_CELLS and len({c.cell_id for c in cells}) == len(cells)
    at = {r.doc_id: r for r in dense.assign_two_level(v, top, fine).collect()}
    assert len(at) == 900
    by_top = {}
    for c in cells:
        by_top.setdefault(c.top_id, []).append(c)
    tops = {c.cell_id: np.array(c.centroid) for c in top.collect()}
    for i, r in at.items():
        assert tops[r.top_id] @ x[i] >= max(t @ x[i] for t in tops.values()) - 1e-5
        mine = {c.cell_id: np.array(c.centroid) @ x[i] for c in by_top[r.top_id]}
        assert mine[r.cell_id] >= max(mine.values()) - 1e-5
    again = {r.doc_id: r.cell_id for r in dense.assign_two_level(v, top, fine).collect()}
    assert again == {i: r.cell_id for i, r in at.items()}
