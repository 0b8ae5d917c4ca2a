import zlib
from collections import Counter, defaultdict

from llm_cases import DOCS
from retrieva.llm import queries, sharding


def check(got, docs, shards, uneven):
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(docs) and set(load) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load[s] for s in range(shards)) - min(load[s] for s in range(shards)) <= uneven
    return load


def test_op2_sizes_even_and_groups_together(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_sharding(spark, sf).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = sum(len(t.encode()) + 8 for t in docs.values())
    check(got, docs, 24, 0.03 * total / 24)
    groups = defaultdict(set)
    for r in got:
        assert r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        groups[docs[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 1
    assert sorted(map(str, got)) == sorted(map(str, queries.op2_sharding(spark, sf).collect()))


def test_a_group_larger_than_a_shard_is_cut_as_little_as_needed(spark):
    rows = [(i, "same text " * 10, "en", "s", 1) for i in range(400)] + [(1000 + i, f"other {i} " + "x" * (i % 50), "en", "s", 1) for i in range(800)]
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "no id", "en", "s", 1), (7, "same text " * 10, "en", "s", 1)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS id", "2 AS size", "3 AS key"), shards=6).collect()
    total = sum(len((r[1] or "").encode()) + 8 for r in rows)
    load = check(got, rows, 6, 150)
    per = Counter(r.shard for r in got if r.size == 108)
    assert max(per.values()) >= 0.9 * max(load.values()) / 108 and abs(sum(load.values()) - total) == 0
    assert {r.size: r.text_crc32 for r in got if r.doc_id in (5000, 5001)} == {8: 0}


def test_pairs_and_a_general_graph(spark):
    nodes = spark.createDataFrame([(i, 10) for i in range(400)], "id bigint, size bigint")
    links = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(200)], "a bigint, b bigint")
    placed = {r.id: r.shard for r in sharding.balance(nodes, links, shards=4).collect()}
    assert sum(placed[2 * i] != placed[2 * i + 1] for i in range(200)) <= 30  # 150 by chance
    assert max(Counter(placed.values()).values()) - min(Counter(placed.values()).values()) <= 3
    ring = spark.createDataFrame([(i, (i + 1) % 400) for i in range(400)], "a bigint, b bigint")
    placed = {r.id: r.shard for r in sharding.balance(nodes, ring, shards=4).collect()}
    assert sum(placed[i] != placed[(i + 1) % 400] for i in range(400)) < 200  # 300 by chance
    empty = spark.createDataFrame([], DOCS)
    assert sharding.shard_documents(empty).count() == 0
