"""Dense retrieval: exact (flat) and cell-probing (IVF) top-k.

No cross join and no all-pairs rows. Both sides are cut into blocks of bounded
size; a block of queries meets a block of documents through an equi-join on a
replicated block key (``cogroup``), one task multiplies the two blocks with
numpy and emits exactly the first k of each query; a ``row_number`` window then
keeps the global top-k (planned as WindowGroupLimit, partial before the
shuffle). Block counts come from per-cell row counts, so a cell that holds a
third of all vectors is split into as many blocks as its size needs.

Scores are DOUBLE; ranking uses the score rounded to 6 decimals, ties by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import inverse_distance, l2_normalize
from ..session import materialize, ship_package
from .topk import SCORE_DIGITS, ranked_score, top_k

DOC_BLOCK = 4_096       # vectors per document block
QUERY_BLOCK = 512       # queries per query block: a block pair's scores are 16 MB
MAX_CELLS = 1 << 16     # centroids sent to the tasks; more is an error


def _best(q: np.ndarray, d: np.ndarray, dids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, document row, score) of exactly the first min(k, n) documents of each query by (rounded score, id)."""
    s = q @ d.T
    if metric == "l2":
        s = (q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2.0 * s
    key = s if metric == "ip" else -s      # larger key = better
    n, rows, cols, scores = d.shape[0], [], [], []
    for i in range(q.shape[0]):
        idx = np.arange(n)
        if n > k:
            kth = np.partition(key[i], n - k)[n - k]
            # rounding decides among scores near the k-th: rank those by their exact rounded score and id
            idx = np.nonzero(key[i] >= kth - 2 * 10.0 ** -SCORE_DIGITS * max(1.0, abs(kth)))[0]
        exact = s[i, idx] if metric == "ip" else ((d[idx] - q[i]) ** 2).sum(1)
        rounded = np.round(exact, SCORE_DIGITS)
        order = np.lexsort((dids[idx], -rounded if metric == "ip" else rounded))[:k]
        rows.append(np.full(len(order), i))
        cols.append(idx[order])
        scores.append(exact[order])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _make_block_fn(k: int, metric: str, qid: str, did: str, qvec: str, dvec: str, schema):
    def fn(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(dpdf) == 0:
            return pd.DataFrame({c: [] for c in schema.fieldNames()})
        q = np.stack(qpdf[qvec].to_numpy()).astype(np.float64)
        d = np.stack(dpdf[dvec].to_numpy()).astype(np.float64)
        dids = dpdf[did].to_numpy()
        rows, cols, scores = _best(q, d, dids, k, metric)
        return pd.DataFrame({schema.fieldNames()[0]: qpdf[qid].to_numpy()[rows], schema.fieldNames()[1]: dids[cols],
                             schema.fieldNames()[2]: scores})
    return fn


def knn_candidates(queries: DataFrame, docs: DataFrame, k: int, metric: str = "ip",
                   qid: str = "query_id", did: str = "doc_id", qvec: str = "qvec", dvec: str = "dvec",
                   cell: str | None = None, doc_block: int = DOC_BLOCK,
                   query_block: int = QUERY_BLOCK) -> DataFrame:
    """Top-k of each (query, document block): at most k rows for each, also when all scores are equal.

    With ``cell`` set, a query row only meets documents of the same cell (IVF
    probing: queries arrive exploded over their probed cells). Block numbers come
    from one row of counts for each cell."""
    ship_package(queries.sparkSession)
    qtype = queries.schema[qid].dataType
    dtype = docs.schema[did].dataType
    out_schema = T.StructType([T.StructField("query_id", qtype), T.StructField("doc_id", dtype),
                               T.StructField("score", T.DoubleType())])
    if cell is None:
        # one cell: its block numbers are two counts, so no join is needed
        ndb = F.lit(max(1, -(-docs.count() // doc_block)))
        nqb = F.lit(max(1, -(-queries.count() // query_block)))
        d, q = docs.withColumn("__cell", F.lit(0)), queries.withColumn("__cell", F.lit(0))
    else:
        dstats = docs.groupBy(cell).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / doc_block)).cast("int").alias("__ndb"))
        qstats = queries.groupBy(cell).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / query_block)).cast("int").alias("__nqb"))
        stats = dstats.join(qstats, cell).withColumnRenamed(cell, "__cell")
        d, q = (x.withColumn("__cell", F.col(cell)).join(stats, "__cell") for x in (docs, queries))
        ndb, nqb = F.col("__ndb"), F.col("__nqb")
    d = (d.withColumn("__db", F.pmod(F.xxhash64(did), ndb).cast("int"))
          .withColumn("__qb", F.explode(F.sequence(F.lit(0), nqb.cast("int") - 1))))
    q = (q.withColumn("__qb", F.pmod(F.xxhash64(qid), nqb).cast("int"))
          .withColumn("__db", F.explode(F.sequence(F.lit(0), ndb.cast("int") - 1))))
    d = d.select("__cell", "__qb", "__db", did, dvec)
    q = q.select("__cell", "__qb", "__db", qid, qvec)
    fn = _make_block_fn(k, metric, qid, did, qvec, dvec, out_schema)
    return (q.groupBy("__cell", "__qb", "__db").cogroup(d.groupBy("__cell", "__qb", "__db"))
             .applyInPandas(fn, schema=out_schema))


def knn(queries: DataFrame, docs: DataFrame, k: int = 5, metric: str = "ip", **kw) -> DataFrame:
    """J6/V1 (and V5 with ``metric='l2'``): exact top-k per query.

    Output (query_id, doc_id, score, rank). ``ip``: higher first; ``l2``:
    squared distance, lower first. Fewer documents than k give fewer rows."""
    cand = knn_candidates(queries, docs, k, metric, **kw)
    order = F.desc(ranked_score("score")) if metric == "ip" else F.asc(ranked_score("score"))
    return top_k(cand, "query_id", [order, F.asc("doc_id")], k)


# --- IVF (V2-V4, J7) ------------------------------------------------------------

def nlist_for(n: int, per_cell: int = 10, cap: int = 100) -> int:
    """V2: number of cells ``min(n // 10, 100)``, at least 1."""
    return max(1, min(n // per_cell, cap))


def train_centroids(vectors: DataFrame, nlist: int, vec: str = "dvec", seed: int = 1,
                    max_iter: int = 20) -> DataFrame:
    """V2: k-means cells with Spark ML. Output (cell_id INT, centroid ARRAY<DOUBLE>)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    if nlist > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    feats = vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
    spark = vectors.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cell_id int, centroid array<double>")


def fixed_centroids(vectors: DataFrame, nlist: int, id_col: str = "doc_id", vec: str = "dvec") -> DataFrame:
    """V2 test form: the ``nlist`` lowest-id vectors serve as centroids."""
    return (vectors.orderBy(id_col).limit(nlist)
                   .select((F.row_number().over(Window.orderBy(id_col)) - 1)  # nlist rows: at most MAX_CELLS
                           .cast("int").alias("cell_id"),
                           F.col(vec).cast("array<double>").alias("centroid")))


def _nearest_cells(vectors: DataFrame, centroids: DataFrame, n: int, vec: str) -> DataFrame:
    """``vectors`` with ``cell_id``, one row for each of the ``n`` best cells by inner product (ties: lowest cell_id).

    Map-only: the centroids, whose number is checked, go to the tasks, and vectors stay where they are read."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = centroids.select("cell_id", F.col("centroid").cast("array<double>").alias("c")).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    rows.sort(key=lambda r: r["cell_id"])
    sent = spark.sparkContext.broadcast((np.array([r["cell_id"] for r in rows], dtype=np.int32), np.array([r["c"] for r in rows], dtype=np.float64)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells(vs: pd.Series) -> pd.Series:
        ids, c = sent.value
        if not len(ids):
            return pd.Series([[] for _ in vs])
        out = []
        for at in range(0, len(vs), 1024):
            x = np.stack(vs.iloc[at:at + 1024].to_numpy()).astype(np.float64)
            s = np.round(x @ c.T, SCORE_DIGITS)
            out += [ids[np.lexsort((ids, -row))[:n]] for row in s]
        return pd.Series(out, dtype=object)

    return vectors.withColumn("cell_id", F.explode(cells(F.col(vec))))


def assign_cells(vectors: DataFrame, centroids: DataFrame, id_col: str = "doc_id",
                 vec: str = "dvec") -> DataFrame:
    """V3: nearest cell by inner product (ties: lowest cell_id). Adds ``cell_id``."""
    return _nearest_cells(vectors, centroids, 1, vec)


def ivf_search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int = 5,
               nprobe: int = 1, metric: str = "ip", qid: str = "query_id", did: str = "doc_id",
               qvec: str = "qvec", dvec: str = "dvec") -> DataFrame:
    """Probe the ``nprobe`` best cells of each query, exact top-k inside them.

    Only the probed cells (at most MAX_CELLS numbers) are read: of vectors saved by cell, no other folder is opened."""
    q = materialize(_nearest_cells(queries.select(qid, qvec), centroids, nprobe, qvec), "probes")
    probed = [r[0] for r in q.select("cell_id").distinct().collect()]
    near = assigned.select(did, dvec, "cell_id").filter(F.col("cell_id").isin(probed) if probed else F.lit(False))
    cand = knn_candidates(q, near, k, metric, qid=qid, did=did, qvec=qvec, dvec=dvec, cell="cell_id")
    order = F.desc(ranked_score("score")) if metric == "ip" else F.asc(ranked_score("score"))
    return top_k(cand, "query_id", [order, F.asc("doc_id")], k)


# --- exact search over cells (V4 with a recall of 1), two-level cells (V2 beyond MAX_CELLS) ------------

BOUNDS = ["cell_id", "centroid", "n", "radius", "least_norm", "most_norm", "least_cos"]


def cell_bounds(assigned: DataFrame, centroids: DataFrame, vec: str = "dvec") -> DataFrame:
    """Centroids with what bounds an inner product inside their cell: number of vectors, largest distance from the centroid, least and largest
    norm, least cosine with the centroid (null centroid or vectors of norm 0: -1). Cells without vectors are left out."""
    v = assigned.select("cell_id", F.col(vec).cast("array<double>").alias("v")).join(centroids.select("cell_id", F.col("centroid").cast("array<double>").alias("centroid")), "cell_id")

    def total(a, b, f):
        return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, x: acc + x)

    v = v.withColumn("__d", F.sqrt(total("v", "centroid", lambda x, y: (x - y) * (x - y)))).withColumn("__n", F.sqrt(total("v", "v", lambda x, y: x * y))) \
         .withColumn("__ip", total("v", "centroid", lambda x, y: x * y)).withColumn("__c", F.sqrt(total("centroid", "centroid", lambda x, y: x * y)))
    cos = F.coalesce(F.col("__ip") / F.nullif(F.col("__n") * F.col("__c"), F.lit(0.0)), F.lit(-1.0))
    stats = v.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("radius"), F.min("__n").alias("least_norm"), F.max("__n").alias("most_norm"), F.min(cos).alias("least_cos"))
    return centroids.select("cell_id", F.col("centroid").cast("array<double>").alias("centroid")).join(stats, "cell_id").select(*BOUNDS)


class _Bounds:
    """Rows of ``cell_bounds`` as arrays (at most MAX_CELLS, checked)."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["cell_id"])
        self.ids = np.array([r["cell_id"] for r in rows], dtype=np.int32)
        self.c = np.array([r["centroid"] for r in rows], dtype=np.float64)
        self.n, self.radius, self.least, self.most, self.cos = (np.array([r[x] for r in rows], dtype=np.float64) for x in BOUNDS[2:])
        self.norm = np.sqrt((self.c ** 2).sum(1))

    def upper(self, q: np.ndarray) -> np.ndarray:
        """No vector of a cell has a larger inner product with q: by the cell's radius, and by the angle between q and its centroid less the
        widest angle in the cell."""
        ip, size = self.c @ q, float(np.sqrt((q * q).sum()))
        by_radius = ip + size * self.radius
        scale = size * self.norm
        angle = np.arccos(np.clip(np.divide(ip, scale, out=np.ones_like(ip), where=scale > 0), -1, 1)) - np.arccos(np.clip(self.cos, -1, 1))
        best = np.cos(np.clip(angle, 0, np.pi))
        by_angle = np.where(scale > 0, size * best * np.where(best > 0, self.most, self.least), size * self.most)
        return np.minimum(by_radius, by_angle) + 1e-9 * (1 + size * self.most)


def ivf_search_exact(queries: DataFrame, assigned: DataFrame, bounds: DataFrame, k: int = 5, qid: str = "query_id", did: str = "doc_id",
                     qvec: str = "qvec", dvec: str = "dvec") -> tuple[DataFrame, DataFrame]:
    """V4 with a recall of 1, by inner product: (hits as ``knn`` gives them, (query_id, cells, probed)).

    Each query first probes its best cells, as many as hold k vectors. Their k-th score is a lower limit; of the other cells only those whose upper
    bound reaches it can hold a better vector, and those are probed too. ``bounds`` (``cell_bounds``) goes to the tasks, its size is checked."""
    spark = queries.sparkSession
    ship_package(spark)
    rows = bounds.select(*BOUNDS).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    if not rows:
        none = knn(queries, assigned.select(did, dvec).limit(0), k, qid=qid, did=did, qvec=qvec, dvec=dvec)
        return none, queries.select(F.col(qid).alias("query_id"), F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("probed"))
    sent = spark.sparkContext.broadcast(_Bounds(rows))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(qs: pd.Series) -> pd.Series:
        b, out = sent.value, []
        for q in qs:
            order = np.argsort(-(b.c @ np.asarray(q, dtype=np.float64)), kind="stable")
            out.append(b.ids[order[:int(np.searchsorted(np.cumsum(b.n[order]), k)) + 1]])
        return pd.Series(out, dtype=object)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def further(qs: pd.Series, limits: pd.Series, had: pd.Series) -> pd.Series:
        b, out = sent.value, []
        for q, limit, cells in zip(qs, limits, had, strict=True):
            upper = b.upper(np.asarray(q, dtype=np.float64))
            out.append(np.setdiff1d(b.ids[upper >= limit - 2e-6], np.asarray(cells, dtype=np.int32)))  # ranked by six decimals
        return pd.Series(out, dtype=object)

    def probe(q: DataFrame, cells: str) -> DataFrame:
        each = materialize(q.select(qid, qvec, F.explode(cells).alias("cell_id")), "probes")
        wanted = [r[0] for r in each.select("cell_id").distinct().collect()]  # at most MAX_CELLS numbers
        near = assigned.select(did, dvec, "cell_id").filter(F.col("cell_id").isin(wanted) if wanted else F.lit(False))
        return top_k(knn_candidates(each, near, k, qid=qid, did=did, qvec=qvec, dvec=dvec, cell="cell_id"), "query_id", [F.desc(ranked_score("score")), F.asc("doc_id")], k).drop("rank")

    q = materialize(queries.select(qid, qvec).withColumn("__first", nearest(F.col(qvec))), "first-probes")
    head = materialize(probe(q, "__first"), "first-hits")
    limit = head.groupBy(F.col("query_id").alias("__q")).agg(F.count(F.lit(1)).alias("__n"), F.min("score").alias("__least"))
    q = q.join(limit, F.col(qid) == F.col("__q"), "left")
    least = F.when(F.col("__n") >= k, F.col("__least")).otherwise(F.lit(float("-inf")))
    q = materialize(q.withColumn("__more", further(F.col(qvec), least, F.col("__first"))).drop("__q", "__n", "__least"), "further-probes")
    hits = top_k(head.unionByName(probe(q, "__more")), "query_id", [F.desc(ranked_score("score")), F.asc("doc_id")], k)
    return hits, q.select(F.col(qid).alias("query_id"), F.lit(len(rows)).cast("long").alias("cells"), (F.size("__first") + F.size("__more")).cast("long").alias("probed"))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Centroids of at most k cells of a bounded sample."""
    c = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        nearest = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        filled = np.unique(nearest)
        c = np.stack([x[nearest == i].mean(0) for i in filled])
    return c


def train_two_level(vectors: DataFrame, coarse: int, fine: int, vec: str = "dvec", seed: int = 1, sample: int = 1 << 17, sample_per_cell: int = 1 << 13) -> tuple[DataFrame, DataFrame]:
    """V2 without a limit on the number of cells: (coarse(cell_id, centroid), fine(cell_id, top_id, centroid)).

    The coarse centroids (MAX_CELLS at most) are fitted on a random sample of about ``sample`` vectors; each coarse cell is then split into up to ``fine`` cells by a
    task of its own, on about ``sample_per_cell`` of its vectors (documented bounds; every vector is assigned afterwards). Fine
    centroids are made and stay on the executors: none of them is collected or broadcast."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = vectors.select(F.col(vec).cast("array<double>").alias("v"))
    n = max(1, v.count())
    some = v.filter(F.rand(seed) < F.lit(min(1.0, sample / n)))
    top = materialize(train_centroids(some, coarse, "v", seed), "coarse-centroids")
    at = _nearest_cells(v, top, 1, "v")
    sizes = materialize(at.groupBy("cell_id").count(), "coarse-sizes")  # one row for each coarse cell
    part = at.join(F.broadcast(sizes), "cell_id").filter(F.rand(seed + 1) < F.lit(float(sample_per_cell)) / F.col("count")).select("cell_id", "v")

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        c = _kmeans(x[np.lexsort(x.T[::-1])], fine, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"top_id": np.full(len(c), key[0], np.int32), "cell_id": int(key[0]) * fine + np.arange(len(c), dtype=np.int64), "centroid": list(c)})

    return top, materialize(part.groupBy("cell_id").applyInPandas(split, "top_id int, cell_id long, centroid array<double>"), "fine-centroids")


def assign_two_level(vectors: DataFrame, top: DataFrame, fine: DataFrame, id_col: str = "doc_id", vec: str = "dvec") -> DataFrame:
    """(id, top_id, cell_id): the nearest fine cell inside the nearest coarse cell, by inner product (ties: lowest number). Vectors meet the fine centroids of
    their coarse cell only, in blocks of bounded size. A coarse cell without fine ones keeps its vectors with a null cell_id."""
    at = _nearest_cells(vectors.select(F.col(id_col).alias("query_id"), F.col(vec).alias("qvec")), top, 1, "qvec").withColumnRenamed("cell_id", "top_id")
    at = materialize(at, "two-level-vectors")
    docs = fine.select(F.col("cell_id").alias("doc_id"), F.col("centroid").alias("dvec"), "top_id")
    best = top_k(knn_candidates(at, docs, 1, cell="top_id"), "query_id", [F.desc(ranked_score("score")), F.asc("doc_id")], 1)
    best = best.select(F.col("query_id").alias("__id"), F.col("doc_id").alias("cell_id"))
    return at.join(best, F.col("query_id") == F.col("__id"), "left").select(F.col("query_id").alias(id_col), "top_id", "cell_id")


def to_similarity(hits: DataFrame, how: str = "neg") -> DataFrame:
    """Squared L2 distances as "higher is better" scores: ``neg`` (-d) or ``inverse`` (1 / (1 + d))."""
    if how not in ("neg", "inverse"):
        raise ValueError("how must be 'neg' or 'inverse'")
    return hits.withColumn("score", -F.col("score") if how == "neg" else inverse_distance("score"))


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact top-k hits that the approximate search also returns."""
    hit = exact.join(approx.select("query_id", "doc_id", F.lit(1).alias("__h")), ["query_id", "doc_id"], "left")
    return hit.agg((F.sum(F.coalesce("__h", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def normalized(df: DataFrame, vec: str) -> DataFrame:
    """T9 applied to a vector column."""
    return df.withColumn(vec, l2_normalize(vec))
