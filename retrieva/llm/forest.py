"""Embedding near-duplicates by centres of dense groups, exactly, and a forest of random-projection trees for the rest.

Equal vectors are one class. Centres are the means of the balls of a bounded sample that hold DENSE others or more. A class within the
limit of a centre is a core of its nearest centre, and it is compared, in blocks, with all classes that could link with it: by
the triangle inequality those within twice the limit's angle of the centre, less those farther than one such angle behind the plane between
the centre and their own nearest. So a core has all its links, however large its group is, and no group is halved by its own noise.

The other classes, with no centre near, go into the forest. Every tree splits them recursively at the median of their projections on a random direction
(one direction for a tree and level); the classes near the median, SPILL of them, go down both sides. Within a leaf all cosines are
computed and those of at least the limit are links, verified in double precision. A pair that meets in several leaves counts in
the smallest-numbered one that both have, which each class's list of leaves tells, so links are counted without sending
pairs around: a leaf returns a number for each class and the edges of a spanning forest. Components are then joined.

The upper levels' medians are fitted on a bounded sample (SAMPLE classes by hash) and all classes are routed through them in one
pass. Leaves that are still too large are split further, level by level, with medians from grouped quantiles, unless a quarter or
more of the pairs among some of their classes are links (a group the first sample was too thin for). A leaf that can't or shouldn't be split is
compared in blocks, so that no task gets more than two blocks.

Cases: a vector that is null, empty, zero or has null or non-finite components links with nothing; only vectors of one length
are compared; rows with equal ids or equal vectors each return a row; a null id links but is no component id (null if there is no other); an
empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrieva.session import materialize, ship_package

from .common import broadcast_if_small, small_batches
from .graph import components

LIMIT = 0.9
TREES, LEAF, SPILL, SEED = 12, 192, 0.12, 7
#: Classes that the upper levels are fitted on, and how many of them a node needs.
SAMPLE, NODE_SAMPLE = 1 << 14, 32
#: A leaf above this is split further; rows of a block of a leaf that can't be.
LARGE, BLOCK, MORE_LEVELS = 1024, 1024, 40
#: Links of a sampled class that make its ball a centre; rows looked at, and share of linked pairs, that keep a large leaf whole.
DENSE, LOOKED_AT, WHOLE = 8, 64, 0.25
_TREE = 48  # a leaf's number: tree, then the path from the root with a leading 1


@cache
def direction(tree: int, level: int, dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, tree, level, dim)).standard_normal(dim)


def unit(raw: bytes) -> np.ndarray | None:
    """Unit vector in double precision, or None."""
    v = np.frombuffer(raw, dtype="<f8")
    if not len(v) or not np.isfinite(v).all() or not np.abs(v).max() > 0:
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def as_bytes(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw): doubles of a usable vector as bytes, else null."""
    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raws = []
            for v in pdf.pop("v"):
                a = None if v is None else np.asarray([np.nan if x is None else x for x in v], dtype="<f8")
                raws.append(None if a is None or unit(a.tobytes()) is None else (a + 0.0).tobytes())
            yield pdf.assign(raw=raws)

    # ids travel as text, so that large and null ids pass through pandas unchanged
    kind = rows.schema[id_col].dataType
    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(
        pack, "id string, raw binary").withColumn("id", F.col("id").cast(kind))


def dense_centres(x: np.ndarray, limit: float, dense: int = DENSE) -> np.ndarray:
    """Unit means of balls of ``x`` in which a vector has ``dense`` links or more, largest first; no ball counts what an earlier one holds."""
    step, free, centres = 1024, np.ones(len(x), bool), []
    degree = np.concatenate([np.zeros(0, np.int64), *((x[i:i + step] @ x.T >= limit).sum(1) - 1 for i in range(0, len(x), step))])
    while len(x) and degree.max() >= dense:
        i = int(degree.argmax())
        centre = x[i]
        for _ in range(2):
            mean = x[free & (x @ centre >= limit)].sum(0)
            centre = mean / np.sqrt(mean @ mean)
        inside = free & (x @ centre >= limit)
        if inside.sum() > dense:
            centres.append(centre)
        else:  # the mean has moved off: the class itself is the centre
            centres.append(x[i])
            inside = free & (x @ x[i] >= limit)
        inside[i] = True
        free &= ~inside
        held = np.flatnonzero(inside)
        for j in range(0, len(held), step):
            degree -= (x @ x[held[j:j + step]].T >= limit).sum(1)
        degree[~free] = 0
    return np.array(centres).reshape(-1, x.shape[1])


def near_centres(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre if x is a core of it, else -1; for each row and centre, whether the row could link with a core of it)."""
    angle, slack = np.arccos(np.clip(limit, -1, 1)), 1e-6
    p = x @ centres.T
    home, rows = p.argmax(1), np.arange(len(x))
    most = p[rows, home]
    reach = p >= np.cos(min(2 * angle, np.pi)) - slack
    if angle < np.pi / 2:
        reach &= most[:, None] - p <= np.sin(angle) * gaps[home] + slack
    return np.where(most >= limit, home, -1), reach


class Forest:
    """Directions and, for each tree and level, the limits of every node's overlap."""

    def __init__(self, sample: np.ndarray, levels: int, trees: int, spill: float):
        self.dim, self.levels, self.trees, self.limits = sample.shape[1], levels, trees, []
        for t in range(trees):
            node, per_level = np.zeros(len(sample), np.int64), []
            for level in range(levels):
                p = sample @ direction(t, level, self.dim)
                order = np.lexsort((p, node))
                size = np.bincount(node, minlength=1 << level)
                first = np.cumsum(size) - size

                def at(q: float) -> np.ndarray:
                    i = np.minimum(first + (size * q).astype(np.int64), first + size - 1)
                    return np.where(size > 1, p[order[np.clip(i, 0, len(p) - 1)]], np.inf)

                low, middle, high = at(0.5 - spill / 2), at(0.5), at(0.5 + spill / 2)
                per_level.append((low, high))
                node = 2 * node + (p > middle[node])
            self.limits.append(per_level)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number, leaf) for every leaf that each row of x gets to."""
        rows, leaves = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.levels):
                low, high = self.limits[t][level]
                p = (x @ direction(t, level, self.dim))[row]
                left, right = p <= high[node], p > low[node]
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows.append(row)
            leaves.append(node + (1 << self.levels) + (t << _TREE))
        return np.concatenate(rows), np.concatenate(leaves)


def _split_large(placed: DataFrame, classes: DataFrame, large: int, spill: float, limit: float) -> DataFrame:
    """Split leaves above ``large`` further, but for those full of links: placed(k, leaf). Medians are quantiles grouped by leaf."""
    code = (1 << _TREE) - 1

    @F.pandas_udf("double")
    def projection(raws: pd.Series, leaf: pd.Series) -> pd.Series:
        out = []
        for r, n in zip(raws, leaf, strict=True):
            u = unit(r)
            out.append(float(u @ direction(n >> _TREE, (n & code).bit_length() - 1, len(u))))
        return pd.Series(out, dtype="float64")

    def linked_share(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([unit(r) for r in pdf["raw"]])
        links = (x @ x.T >= limit).sum() - len(x)
        return pd.DataFrame({"leaf": [int(key[0])] if links >= WHOLE * len(x) * max(1, len(x) - 1) else []}, dtype="int64")

    whole = None
    for _ in range(MORE_LEVELS):
        sizes = placed.groupBy("leaf").count()
        over = sizes.filter((F.col("count") > large) & (F.col("leaf").bitwiseAND(F.lit(code)) < 1 << (_TREE - 2)))
        over = materialize(over if whole is None else over.join(whole, "leaf", "left_anti"), "forest-over")
        if over.isEmpty():
            break
        some = placed.join(broadcast_if_small(over), "leaf").filter(F.pmod(F.xxhash64("k", "leaf"), F.col("count")) < LOOKED_AT)
        some = some.join(classes.select("k", "raw"), "k").groupBy("leaf", F.octet_length("raw").alias("size"))
        full = some.applyInPandas(linked_share, "leaf long").distinct()
        whole = materialize(full if whole is None else whole.unionByName(full), "forest-whole")
        over = broadcast_if_small(materialize(over.join(whole, "leaf", "left_anti").select("leaf"), "forest-to-split"))
        p = placed.join(over, "leaf").join(classes.select("k", "raw"), "k").select("k", "leaf", projection("raw", "leaf").alias("p"))
        p = materialize(p, "forest-projections")
        q = p.groupBy("leaf").agg(F.percentile_approx("p", F.array(F.lit(0.5 - spill / 2), F.lit(0.5 + spill / 2)), F.lit(1000)).alias("q"),
                                  F.max("p").alias("most"))
        # no split by the median if the upper half of the leaf has one projection
        q = q.filter(F.col("q")[0] < F.col("most")).select("leaf", F.col("q")[0].alias("low"), F.when(F.col("q")[1] < F.col("most"), F.col("q")[1]).otherwise(F.col("q")[0]).alias("high"))
        sides = F.filter(F.array(F.when(F.col("p") <= F.col("high"), 0), F.when(F.col("p") > F.col("low"), 1)), lambda x: x.isNotNull())
        head, path = F.shiftright("leaf", _TREE), F.col("leaf").bitwiseAND(F.lit(code))
        child = F.shiftleft(head, _TREE) + path * 2 + F.col("side")
        split = p.join(broadcast_if_small(materialize(q, "forest-medians")), "leaf").select("k", "leaf", F.explode(sides).alias("side"))
        moved = materialize(split.select("k", "leaf", child.alias("child")), "forest-moved")
        if moved.isEmpty():
            break
        done = broadcast_if_small(materialize(moved.select("leaf").distinct(), "forest-split"))
        placed = materialize(placed.join(done, "leaf", "left_anti").unionByName(moved.select("k", F.col("child").alias("leaf"))), "forest-placed")
    return placed


def _compare(limit: float):
    """Links within one block pair of a leaf: a count for each class, and edges that span what is linked."""
    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, a, b = (int(x) for x in key)
        x = np.vstack([unit(r) for r in pdf["raw"]])
        linked = x @ x.T >= limit
        np.fill_diagonal(linked, False)
        if a != b:
            side = pdf["block"].to_numpy() == a
            linked &= side[:, None] != side[None, :]
        ks = pdf["k"].to_numpy(np.int64)
        # a pair belongs to the smallest leaf that both are in: leave out pairs that share a smaller one
        smaller = [np.asarray(v, np.int64) for v in pdf["leaves"]]
        smaller = [v[v < leaf] for v in smaller]
        names, at = np.unique(np.concatenate(smaller) if smaller else np.empty(0, np.int64), return_inverse=True)
        new = linked
        if len(names) and linked.any():
            inside = np.zeros((len(ks), len(names)), np.float32)
            inside[np.repeat(np.arange(len(ks)), [len(v) for v in smaller]), at] = 1
            new = linked & ~(inside @ inside.T > 0)
        counts = new @ pdf["n"].to_numpy(np.int64)
        label = np.arange(len(ks))
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], len(ks)).min(1, initial=len(ks)))
            if (least == label).all():
                break
            label = least
        out = (counts > 0) | (label != np.arange(len(ks)))
        return pd.DataFrame({"k": ks[out], "links": counts[out], "to": ks[label][out]})

    return of


def _compare_cores(limit: float):
    """Links of a block of a centre's cores with a block of the classes in its reach; a class that is a core elsewhere counts them there."""
    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["as_core"].to_numpy(bool)
        c, m = pdf[mine], pdf[~mine]
        if not len(c) or not len(m):
            return pd.DataFrame({"k": [], "links": [], "to": []}, dtype="int64")
        kc, km = c["k"].to_numpy(np.int64), m["k"].to_numpy(np.int64)
        linked = np.vstack([unit(r) for r in c["raw"]]) @ np.vstack([unit(r) for r in m["raw"]]).T >= limit
        linked &= kc[:, None] != km[None, :]
        counts_c = linked @ m["n"].to_numpy(np.int64)
        counts_m = np.where(m["home"].to_numpy(np.int64) < 0, c["n"].to_numpy(np.int64) @ linked, 0)
        lc, lm, none = kc, km, np.iinfo(np.int64).max
        while True:
            to_c = np.minimum(lc, np.where(linked, lm[None, :], none).min(1))
            to_m = np.minimum(lm, np.where(linked, to_c[:, None], none).min(0))
            if (to_c == lc).all() and (to_m == lm).all():
                break
            lc, lm = to_c, to_m
        k, links, to = np.concatenate((kc, km)), np.concatenate((counts_c, counts_m)), np.concatenate((lc, lm))
        out = (links > 0) | (to != k)
        return pd.DataFrame({"k": k[out], "links": links[out], "to": to[out]})

    return of


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = LIMIT, trees: int = TREES,
                    leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession
    ship_package(spark)
    small_batches(spark)
    vectors = materialize(as_bytes(rows, id_col, vector_col), "forest-vectors")
    classes = materialize(vectors.filter("raw IS NOT NULL").groupBy("raw").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "forest-distinct")
    classes = materialize(classes.withColumn("k", F.monotonically_increasing_id()), "forest-classes")  # numbered once, then read
    tally = {r["dim"]: r["n"] for r in classes.groupBy((F.octet_length("raw") / 8).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    samples, centres = {}, {}
    for dim, n in tally.items():
        part = classes.filter(F.octet_length("raw") == 8 * dim)
        chosen = part.filter(F.pmod(F.xxhash64(F.lit(SEED), "raw"), F.lit(1 << 52)) < max(1, int((1 << 52) * min(1.0, sample / n))))
        samples[dim] = np.array([unit(r["raw"]) for r in chosen.select("raw").collect()]).reshape(-1, dim)  # about ``sample`` rows
        found = dense_centres(samples[dim], limit)
        if len(found):
            between = np.sqrt(np.maximum(0, 2 - 2 * found @ found.T))
            centres[dim] = (found, between)
            samples[dim] = samples[dim][(samples[dim] @ found.T).max(1) < limit]
    near = spark.sparkContext.broadcast(centres)

    def gather(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            homes, reached = np.full(len(pdf), -1, np.int64), [[] for _ in range(len(pdf))]
            dims = pdf["raw"].map(len).to_numpy() // 8
            for dim in np.unique(dims):
                if dim in near.value:
                    at = np.flatnonzero(dims == dim)
                    homes[at], reach = near_centres(np.vstack([unit(r) for r in pdf["raw"].iloc[at]]), *near.value[dim], limit)
                    for i, part in zip(at, reach, strict=True):
                        reached[i] = np.flatnonzero(part)
            yield pd.DataFrame({"k": pdf["k"], "n": pdf["n"], "raw": pdf["raw"], "home": homes, "reached": reached})

    rest, compared = classes, []
    if centres:
        gathered = materialize(classes.select("k", "n", "raw").mapInPandas(gather, "k long, n long, raw binary, home long, reached array<long>"), "forest-gathered")
        rest = gathered.filter("home < 0").select("k", "n", "raw")
        tally |= {dim: 0 for dim in tally} | {r["dim"]: r["n"] for r in rest.groupBy((F.octet_length("raw") / 8).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
        dim = (F.octet_length("raw") / 8).cast("int").alias("dim")
        reach = gathered.select("k", "n", "raw", "home", dim, F.explode("reached").alias("centre"))
        wide = 2 * block  # cores and others are compared as a rectangle
        counted = reach.groupBy("dim", "centre").agg(F.ceil(F.count_if(F.col("home") == F.col("centre")) / wide).cast("int").alias("ours"), F.ceil(F.count(F.lit(1)) / wide).cast("int").alias("theirs"))
        counted = materialize(counted.filter("ours > 0"), "forest-cores")
        reach = reach.join(broadcast_if_small(counted), ["dim", "centre"])
        hashed = F.xxhash64("k")
        as_other = reach.select("*", F.lit(False).alias("as_core"), F.pmod(hashed, F.col("theirs")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("ours") - 1)).alias("a"))
        as_core = reach.filter("home = centre").select("*", F.lit(True).alias("as_core"), F.pmod(hashed, F.col("ours")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("b"))
        pairs = as_other.unionByName(as_core).groupBy("dim", "centre", "a", "b")
        compared = [materialize(pairs.applyInPandas(_compare_cores(limit), "k long, links long, to long"), "forest-core-links")]
    forests = {}
    for dim, n in tally.items():  # one forest for each length of vector
        x = samples[dim]
        deepest = max(0, int(np.log2(max(1, len(x)) / NODE_SAMPLE)))
        forests[dim] = Forest(x, min(deepest, max(0, int(np.ceil(np.log2(max(1, n) / leaf))))), trees, spill)
    sent = spark.sparkContext.broadcast(forests)

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            leaves: list = [None] * len(pdf)
            dims = pdf["raw"].map(len).to_numpy() // 8
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                row, number = sent.value[dim].route(np.vstack([unit(r) for r in pdf["raw"].iloc[at]]))
                order = np.argsort(row, kind="stable")
                for i, part in zip(at, np.split(number[order], np.cumsum(np.bincount(row, minlength=len(at)))[:-1]), strict=True):
                    leaves[i] = part
            yield pd.DataFrame({"k": pdf["k"], "n": pdf["n"], "raw": pdf["raw"], "leaves": leaves})

    placed = materialize(rest.select("k", "n", "raw").mapInPandas(place, "k long, n long, raw binary, leaves array<long>"), "forest-leaves")
    each = placed.select("k", F.explode("leaves").alias("leaf"))
    if not each.groupBy("leaf").count().filter(F.col("count") > large).isEmpty():
        deeper = _split_large(each, classes, large, spill, limit)
        leaves = deeper.groupBy("k").agg(F.collect_set("leaf").alias("leaves"))
        placed = materialize(placed.drop("leaves").join(leaves, "k"), "forest-leaves")
    # vectors of different lengths never share a leaf: the length is part of the group
    one = placed.select("k", "n", "raw", "leaves", (F.octet_length("raw") / 8).cast("int").alias("dim"), F.explode("leaves").alias("leaf"))
    blocks = one.groupBy("leaf", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    one = one.join(broadcast_if_small(materialize(blocks, "forest-blocks")), ["leaf", "dim"])
    one = one.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    one = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = one.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    found = materialize(one.groupBy("leaf", "a", "b", "dim").applyInPandas(
        lambda key, pdf: _compare(limit)(key[:3], pdf), "k long, links long, to long"), "forest-links")
    for more in compared:
        found = found.unionByName(more)
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    merged = components(found.select(F.col("k").alias("a"), F.col("to").alias("b")), "forest-components")
    named = classes.join(merged.select(F.col("node").alias("k"), "component"), "k", "left").join(links, "k", "left").select(
        "raw", "first", "n", F.coalesce("component", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = materialize(named, "forest-named")
    roots = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(roots, "root").select("raw", "component", (F.col("links") + F.col("n") - 1).alias("links"))
    linked = vectors.filter("raw IS NOT NULL").join(named, "raw").select("id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = vectors.filter("raw IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", id_col)


#: DuckDB: every pair, and the closure of the links. Where the forest misses a pair, the rows differ.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
ok AS (SELECT * FROM u WHERE norm > 0 AND isfinite(norm)),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= {LIMIT}),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
