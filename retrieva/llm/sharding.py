"""Sharding by balanced label propagation: linked documents end in one shard as far as capacity allows, sizes stay even.

Linked documents start in hashed shards. In each round every document looks at its neighbours' shards (one join of links and
labels, counts grouped before the shuffle) and wants to move where most of them are, if that is more than where it
is. A document waits if a neighbour in that shard comes first by (fewest links, hash of the round), so the two ends of
a link never swap. Moves are granted by hash bucket up to quotas: between two shards as many
bytes as both ways exchange, and beyond that the capacity that is left; the driver sees only sums by (shard, shard, bucket). A group of links larger than a shard fills it and
leaves the rest where they are, to be cut.

Then documents without links fill the shards up to equal bytes, in three layers from large to small (a line of
running sums, cut where each shard's room ends; loads are measured after each layer), so what remains uneven is
about the size of the smallest documents. Linked documents beyond a shard's capacity, if any, are released to that line too.

Cases: null text has size 8 and equals the empty text; rows that share an id are sharded one by one; a null id is an id
like others; an empty table returns no rows; a document larger than a shard's share makes that shard larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrieva.session import materialize

from .common import ranged

SHARDS, ROUNDS, BUCKETS = 24, 20, 32
#: Shares of the filling documents' bytes in each layer.
LAYERS = (0.6, 0.3, 0.1)


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sums(df: DataFrame, shards: int) -> list[float]:
    """Bytes in each shard (one row for each shard reaches the driver)."""
    found = {r["shard"]: float(r["n"]) for r in df.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    return [found.get(s, 0.0) for s in range(shards)]


def _granted(asked: dict[tuple[int, int], list[float]], room: list[float]) -> dict[tuple[int, int], int]:
    """Buckets granted to the moves between each two shards: first what both ways exchange, then what room there is.

    asked: bytes by bucket for (from, to). ``room`` counts the moves out of a shard as they are granted.
    """
    granted = dict.fromkeys(asked, 0)

    def grant(move: tuple[int, int], most: float) -> None:
        while granted[move] < BUCKETS and asked[move][granted[move]] <= most:
            n = asked[move][granted[move]]
            most -= n
            room[move[0]] += n
            room[move[1]] -= n
            granted[move] += 1

    for i, j in sorted(asked):
        if i < j and (j, i) in asked:
            both = min(sum(asked[i, j]), sum(asked[j, i]))
            grant((i, j), both)
            grant((j, i), both)
    for move in sorted(asked):
        grant(move, room[move[1]])
    return granted


def propagate(nodes: DataFrame, links: DataFrame, capacity: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes(id, size) and links(a, b) between them -> (id, size, shard) of the linked nodes."""
    both = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
                       .unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "shard-links")
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    start = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    labels = materialize(nodes.join(degree, nodes["id"] == degree["src"]).select(
        "id", "size", "degree", start.alias("shard")), "shard-labels")
    for step in range(rounds):
        labels = labels.withColumn("turn", F.struct("degree", F.xxhash64(F.lit(step), "id"), "id"))
        seen = both.join(labels.select(F.col("id").alias("dst"), "shard", "turn"), "dst")
        votes = seen.groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))
        own = labels.select(F.col("id").alias("src"), "size", F.col("shard").alias("at"), "turn")
        v = votes.join(own, "src").groupBy("src").agg(
            F.coalesce(F.max(F.when(F.col("shard") == F.col("at"), F.col("n"))), F.lit(0)).alias("here"),
            F.max(F.when(F.col("shard") != F.col("at"), F.struct("n", "shard", "first"))).alias("best"),
            F.first("at").alias("at"), F.first("size").alias("size"), F.first("turn").alias("turn"))
        wish = materialize(v.filter((F.col("best.n") > F.col("here")) & (F.col("turn") < F.col("best.first"))).select(
            "src", "at", F.col("best.shard").alias("to"), "size", F.pmod(F.xxhash64(F.lit(step), "src"), F.lit(BUCKETS)).alias("bucket")), "shard-moves")
        asked: dict[tuple[int, int], list[float]] = {}
        for r in wish.groupBy("at", "to", "bucket").agg(F.sum("size").alias("n")).collect():  # at most shards * shards * BUCKETS rows
            asked.setdefault((r["at"], r["to"]), [0.0] * BUCKETS)[r["bucket"]] = float(r["n"])
        granted = _granted(asked, [capacity - x for x in _sums(labels, shards)])
        if not any(sum(asked[k][:n]) for k, n in granted.items()):
            break
        allowed = _numbers([granted.get((i, j), 0) for i in range(shards) for j in range(shards)])
        moves = wish.filter(F.col("bucket") < F.get(allowed, F.col("at") * shards + F.col("to"))).select(F.col("src").alias("id"), "to")
        labels = materialize(labels.join(moves, "id", "left").select("id", "size", "degree", F.coalesce("to", "shard").alias("shard")), "shard-labels")
    return labels.select("id", "size", "shard")


def _cut(line: DataFrame, parts: list[float], start: float) -> DataFrame:
    """Shard of each row of a line by its running sum ``before``: consecutive parts of the given lengths."""
    ends, at = [], start
    for p in parts[:-1]:
        at += p
        ends.append(at)
    return line.withColumn("shard", F.size(F.filter(_numbers(ends), lambda e: e <= F.col("before"))).cast("int"))


def fill(rest: DataFrame, load: list[float], capacity: float) -> DataFrame:
    """rest(id, size) -> (id, size, shard): shards filled up to ``capacity`` from ``load``."""
    line = materialize(ranged(rest.withColumn("smaller", -F.col("size")), [], ["smaller", "id"], "size", "shard-line").select("id", "size", "before"), "shard-line")
    total = float(line.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    done, start, load = None, 0.0, list(load)
    for n, share in enumerate(LAYERS):
        end = total if n == len(LAYERS) - 1 else start + share * total
        room = [max(0.0, capacity - x) for x in load]
        scale = (end - start) / sum(room) if sum(room) else 0.0
        parts = [r * scale for r in room] if sum(room) else [(end - start) / len(load)] * len(load)
        here = materialize(_cut(line.filter((F.col("before") >= start) & (F.col("before") < end)), parts, start).select("id", "size", "shard"), "shard-layer")
        load = [a + b for a, b in zip(load, _sums(here, len(load)), strict=True)]
        done, start = here if done is None else done.unionByName(here), end
    return done


def balance(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes(id, size) with distinct ids, links(a, b) -> (id, shard, slot): shards of nearly equal size that cut few links."""
    capacity = float(nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) / shards
    placed = materialize(propagate(nodes, links, capacity, shards, rounds), "shard-linked")
    load = _sums(placed, shards)
    free = nodes.join(placed.select("id"), "id", "left_anti").select("id", "size")
    if any(x > capacity for x in load):
        lined = materialize(ranged(placed, ["shard"], ["id"], "size", "shard-full").select("id", "size", "shard", "before"), "shard-full")
        placed, over = lined.filter(F.col("before") + F.col("size") <= capacity).drop("before"), lined.filter(F.col("before") + F.col("size") > capacity)
        free, load = free.unionByName(over.select("id", "size")), _sums(placed, shards)
    every = placed.select("id", "size", "shard").unionByName(fill(free, load, capacity))
    return ranged(every, ["shard"], ["id"], "size", "shard-slots").select("id", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of docs(doc_id, text); documents with equal texts are linked.

    A group of equal texts is a star around its first row: as many links as rows, not all pairs.
    """
    text = F.coalesce("text", F.lit(""))
    base = materialize(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                                   F.md5(text.cast("binary")).alias("key")), "shard-documents")
    base = materialize(ranged(base, [], ["doc_id", "key"], "size", "shard-rows").withColumnRenamed("slot", "id").drop("before"), "shard-rows")
    # written, so that both sides of the join below are plain shuffles, in which Spark splits a hot text
    groups = materialize(base.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shard-groups")
    links = base.select("id", "key").join(groups, "key").filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    placed = balance(base.select("id", "size"), links, shards, rounds)
    return base.join(placed, "id").select("doc_id", "size", "text_crc32", "shard", "slot")
