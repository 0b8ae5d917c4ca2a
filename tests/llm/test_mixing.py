from llm_cases import DOCS
from retrieva.llm import mixing


def waterfill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshare by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        each = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if each[s] > most * sizes[s]}
        if not above:
            target.update(each)
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i * 7919 % 23), "en", ["b", "a", None, "é", "Z"][0 if i % 3 == 0 else i % 5], 1) for i in range(2000)]
    rows += [(5000, None, "en", "empty", 0), (None, "x y", None, "a", 3), (6, "repeated row", "en", "b", 2), (6, "repeated row", "en", "b", 2)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS hash", "2 AS below", "3 AS passes"))
    again = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in got:
        s = by_id[r.doc_id][3]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
        target[s] = r.target
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = waterfill(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert all(r.source_size == sizes[by_id[r.doc_id][3]] for r in got)


def test_equal_hashes_and_empty_tables(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 4 + [(2, "a", "en", "t", 1)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and len({r.taken for r in got if r.doc_id == 1}) == 1
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_rows_without_an_id_or_with_one_id_come_near_the_target(spark):
    """A third of all rows has no id, a third has id 7: their texts tell them apart."""
    rows = [([None, 7, i][i % 3], f"text {i} " + "w " * 8, "en", "ab"[i % 2], 1) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    target = {r.target for r in got}
    assert abs(sum(r.taken for r in got) - sum(waterfill({"a": 3000, "b": 3000}).values())) <= 2 * 20 and max(target) > min(target)
    for i in (None, 7):
        assert len({r.taken for r in got if r.doc_id == i}) == 2


def test_documents_are_repeated_as_taken(spark):
    rows = [(i, "w " * 5, "en", "ab"[i % 2], 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    words = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    n = {r.doc_id: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert {i: n.get(i, 0) * 5 for i in range(300)} == words
