import os
import tempfile

from pyspark.sql import functions as F

from retrieva.operators import corpus as CO
from retrieva.operators import tables as TB
from retrieva.sources import io


def _dir():
    return tempfile.mkdtemp(prefix="retrieva-test-")


def test_text_corpus_scan(spark):
    d = _dir()
    open(os.path.join(d, "a-b_c.txt"), "w").write("hello\nworld")
    open(os.path.join(d, "b.txt"), "w").write("  \n\t ")
    rows = io.scan_text_corpus(spark, d).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.doc_id == "a-b_c" and r.content == "a b c\n\nhello\nworld" and r.title == "a b c" and r.length == 5
    plain = io.scan_plain_corpus(spark, d).collect()
    assert len(plain) == 2


def test_table_csv_scan_and_keep_rule(spark):
    d = _dir()
    open(os.path.join(d, "a_table0.csv"), "w").write("x,y\n1,2\n,\n3,4\n")
    open(os.path.join(d, "x_table1.csv"), "w").write("p,q\n5,6\n")
    rows = io.read_table_csvs(spark, d)
    kept = TB.keep_tables(rows)
    assert sorted({(r.doc_id, r.page_no) for r in kept.collect()}) == [("a", 0)]
    rendered = TB.render_tables(kept).first().table_text
    assert rendered == "x y\n1 2\n3 4"
    docs = TB.table_documents(TB.render_tables(kept)).first()
    assert docs.doc_id == "a_table0" and docs.content.startswith("a table0\n\n")


def test_render_alignment_and_nan(spark):
    rows = spark.createDataFrame([("d", 0, 0, ["id", "name"]), ("d", 0, 1, ["1", None]), ("d", 0, 2, ["100", "bob"])],
                                 "doc_id string, page_no int, row_no long, cells array<string>")
    assert TB.render_tables(rows).first().table_text == " id name\n  1  NaN\n100  bob"


def test_encodings_and_csv_cells(spark):
    d = _dir()
    open(os.path.join(d, "u.csv"), "w", encoding="utf-8").write('query,reference\ncafé,"x"\n')
    open(os.path.join(d, "l.csv"), "w", encoding="iso-8859-1").write('query,reference\nnaïve,"y"\n')
    got = sorted(r.query for r in io.read_qa_csv(spark, d).collect())
    assert got == ["café", "naïve"]
    d2 = _dir()
    open(os.path.join(d2, "q.csv"), "w").write(
        'query,reference\n" edge ","line\nbreak"\n"say ""hi""",\nNA,x\n')
    rows = io.read_qa_csv(spark, d2, encoding="UTF-8").collect()
    assert rows[0].query == " edge " and rows[0].reference == "line\nbreak"
    assert rows[1].query == 'say "hi"' and rows[1].reference is None
    assert rows[2].query is None


def test_sinks_round_trip(spark):
    d = _dir()
    df = spark.createDataFrame([(" q ", " answer with space")], "query string, answer string")
    io.write_qa_csv(df, os.path.join(d, "k2"))
    back = io.read_qa_csv(spark, os.path.join(d, "k2"), io.ANSWER_SCHEMA, encoding="UTF-8").first()
    assert back.query == " q " and back.answer == " answer with space"
    io.append_log(df, os.path.join(d, "k1"))
    io.append_log(df, os.path.join(d, "k1"))
    assert spark.read.parquet(os.path.join(d, "k1")).count() == 2
    io.append_log(df, os.path.join(d, "k1csv"), "csv")
    log = io.read_qa_csv(spark, os.path.join(d, "k1csv"), io.ANSWER_SCHEMA).collect()
    assert [(r.query, r.answer) for r in log] == [(" q ", " answer with space")]
    report = spark.sql("SELECT 0.5D AS bleu, named_struct('rouge-1', named_struct('r', 1.0D, 'p', 0.5D, 'f', 0.6D)) AS rouge")
    io.write_report(report, os.path.join(d, "k3"))
    assert spark.read.json(os.path.join(d, "k3")).first()["rouge"]["rouge-1"]["p"] == 0.5
    io.write_cleaned(spark.createDataFrame([("a", "text", 1)], "doc_id string, content string, x int"), os.path.join(d, "k5"))
    assert [tuple(r) for r in spark.read.parquet(os.path.join(d, "k5")).collect()] == [("a", "text")]
    rows = spark.createDataFrame([(f"doc{i}", 0, 0, ["x"]) for i in range(200)], "doc_id string, page_no int, row_no long, cells array<string>")
    hot = spark.createDataFrame([("doc7", 0, i, ["y"]) for i in range(1, 800)], rows.schema)
    io.write_tables(rows.unionByName(hot), os.path.join(d, "k6"), rows_per_file=100)
    k6 = spark.read.parquet(os.path.join(d, "k6"))
    assert k6.count() == 999 and k6.filter("table_name = 'doc7_table0'").count() == 800
    sizes = [r["count"] for r in k6.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 6 and max(sizes) < 300  # one document with most of the rows is in several files


def test_every_index_is_searched_from_disk_with_the_same_results(spark):
    import numpy as np

    from retrieva.operators import dense, sparse
    d = _dir()
    docs = spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 3} gamma word{i}") for i in range(60)], "doc_id long, content string")
    q = spark.createDataFrame([(1, "alpha1 gamma beta2"), (2, "nothing here"), (3, "word5 word5 alpha5")], "query_id long, text string")
    tfidf, bm25 = sparse.build_tfidf_index(docs), sparse.build_bm25_index(docs)
    for name, ix, search in (("t", tfidf, sparse.sparse_search), ("b", bm25, sparse.bm25_search)):
        io.save_index(os.path.join(d, name), ix, rows_per_part=25)
        loaded = io.load_index(spark, os.path.join(d, name))
        assert type(loaded) is type(ix) and loaded.n_docs == 60
        parts = {r["part"]: r["count"] for r in loaded.postings.groupBy("part").count().collect()}
        assert max(parts.values()) <= 40 and len(parts) > 6  # "gamma" is in every document: 60 postings in 3 parts
        assert loaded.postings.filter("term = 'gamma'").select("part").distinct().count() == 3
        a = {(r.query_id, r.doc_id): r.score for r in search(ix, q).collect()}
        b = {(r.query_id, r.doc_id): r.score for r in search(loaded, q).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a) and len(a) > 60
    plan = sparse.sparse_search(io.load_index(spark, os.path.join(d, "t")), q)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    x = np.random.default_rng(0).normal(size=(80, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, dvec array<double>")
    qv = v.filter("doc_id < 5").select(F.col("doc_id").alias("query_id"), F.col("dvec").alias("qvec"))
    cents = dense.fixed_centroids(v, 8)
    cells = io.CellIndex(dense.assign_cells(v, cents), cents)
    io.save_index(os.path.join(d, "c"), cells, rows_per_part=4)
    per_cell = {}
    for f in io.load_index(spark, os.path.join(d, "c")).vectors.select("cell_id", F.input_file_name().alias("f")).distinct().collect():
        per_cell.setdefault(f.cell_id, []).append(f.f)
    assert max(map(len, per_cell.values())) > 1  # a large cell is written by several tasks
    loaded = io.load_index(spark, os.path.join(d, "c"))
    for metric in ("ip", "l2"):
        a = sorted(map(tuple, dense.ivf_search(qv, cells.vectors, cells.centroids, 3, 2, metric).collect()))
        assert a == sorted(map(tuple, dense.ivf_search(qv, loaded.vectors, loaded.centroids, 3, 2, metric).collect())) and len(a) > 5
    try:
        io.load_index(spark, os.path.join(d, "none"))
        raise AssertionError("a missing index must be an error")
    except Exception as e:  # noqa: BLE001
        assert "none" in str(e)


def test_table_files_keep_their_own_widths(spark):
    d = _dir()
    open(os.path.join(d, "a_table0.csv"), "w").write("x\n1\n2\n")
    open(os.path.join(d, "b_table1.csv"), "w").write("x,y\n1,\n3\n")
    open(os.path.join(d, "c_table2.csv"), "wb").write('p,q,r,s\n1,"a\nb",3,caf\xe9\n'.encode("latin-1"))
    open(os.path.join(d, "d_table3.csv"), "w").write('x,y\n"open quote,1\n')
    rows = {(r.doc_id, r.page_no, r.row_no): r.cells for r in io.read_table_csvs(spark, d).collect()}
    assert rows[("a", 0, 1)] == ["1"] and rows[("b", 1, 1)] == ["1", None] and rows[("b", 1, 2)] == ["3", None]
    assert rows[("c", 2, 0)] == ["p", "q", "r", "s"] and rows[("c", 2, 1)] == ["1", "a\nb", "3", "caf\xe9"]
    assert not any(k[0] == "d" for k in rows) and [r.path.rsplit("/", 1)[1] for r in io.broken_table_csvs(spark, d).collect()] == ["d_table3.csv"]


def test_listing_dispatch(spark):
    d = _dir()
    for n in ("a.pdf", "b.PNG", "c.jpeg", "d.txt"):
        open(os.path.join(d, n), "wb").write(b"x")
    got = sorted((r.doc_id, r.kind) for r in io.list_raw_documents(spark, d).collect())
    assert got == [("a", "pdf"), ("c", "image")]


def test_clean_text_and_pages(spark):
    df = spark.createDataFrame([(1, "The cats, and the cat's toys! Boxes box; don't"), (2, "!!! ...")],
                               "doc_id long, text string")
    got = {r.doc_id: r.cleaned for r in CO.clean_text(df).collect()}
    assert got[1] == "cats toys box box" and got[2] == ""   # "cat" and "toy" are not corpus tokens
    twice = spark.createDataFrame([(1, "boxes box"), (1, "cats cat boxes"), (None, "cats"), (None, "box")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.cleaned) for r in CO.clean_text(twice).collect()) == [(False, "box box"), (False, "cat cat box"), (True, "box"), (True, "cat")]
    words = spark.createDataFrame([(1, "Mice mouse news feet boxes box children cats cat")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("mice", "mouse"), ("news", "news"), ("feet", "foot"), ("feet", "feets"), ("new", "x"), (None, "y"), ("cats", "feline")], "form string, lemma string")
    assert CO.clean_text(words, lexicon=lexicon).first().cleaned == "mouse mouse news foot box box children feline cat"
    assert CO.clean_text(words, lexicon=CO.irregular_nouns(spark)).first().cleaned == "mouse mouse news foot box box child cat cat"
    people = spark.createDataFrame([(1, "Women woman men man"), (2, None), (3, "\u00a0\u2003")], "doc_id long, text string")
    assert {r.doc_id: r.cleaned for r in CO.clean_text(people).collect()} == {1: "woman woman man man", 2: "", 3: ""}
    blank = spark.createDataFrame([("n", "\u00a0 \u2003\x1c"), ("w", "a\u00a0b\u3000c ")], "doc_id string, text string")
    assert [(r.doc_id, r.length) for r in CO.corpus_rows(blank, "doc_id", "text").collect()] == [("w", 4)]
    pages = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "")], "doc_id long, page_no long, text string")
    assert CO.join_pages(pages, "concat").first().text == "ab"
    assert CO.join_pages(pages, "line_after").first().text == "a\nb\n\n"
    assert CO.join_pages(pages, "between_nonempty").first().text == "a\nb"
    assert CO.mean_words(spark.createDataFrame([], "text string")).first().avg_words is None


def test_stream_equals_batch(spark):
    from retrieva.streaming.stream import answer_stream
    d_in, d_out = _dir(), _dir()
    os.rmdir(d_out)
    qs = [(1, "alpha beta"), (2, "gamma")]
    spark.createDataFrame(qs, "query_id long, text string").coalesce(1).write.mode("overwrite").json(os.path.join(d_in, "b0"))

    def job(batch):
        return batch.select("query_id", F.upper("text").alias("answer"))

    done = _dir()
    calls = []

    def counted(batch):
        calls.append(batch.count())
        return job(batch)

    for _ in range(2):  # the second start goes on after the first's last batch: nothing is answered again
        q = answer_stream(spark, os.path.join(d_in, "b0"), d_out, counted, done)
        q.awaitTermination(120)
    assert calls == [2]
    spark.createDataFrame([(3, "late")], "query_id long, text string").coalesce(1).write.mode("append").json(os.path.join(d_in, "b0"))
    answer_stream(spark, os.path.join(d_in, "b0"), d_out, counted, done).awaitTermination(120)
    qs.append((3, "late"))
    assert calls == [2, 1]
    streamed = sorted(tuple(r) for r in spark.read.parquet(os.path.join(d_out, "answers")).select("query_id", "answer").collect())
    batch = sorted(tuple(r) for r in job(spark.createDataFrame(qs, "query_id long, text string")).collect())
    assert streamed == batch
    # repeated ids (in one file, and of earlier batches) are dropped by state, lines that are no question are kept aside
    lines = ['{"query_id": 4, "text": "four"}', '{"query_id": 4, "text": "four"}', '{"query_id": 1, "text": "again"}', "{broken", '{"text": "no id"}', "[1]", "", '{"query_id": 5}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(os.path.join(d_in, "b0"))
    answer_stream(spark, os.path.join(d_in, "b0"), d_out, counted, done).awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.read.parquet(os.path.join(d_out, "answers")).select("query_id", "answer").collect())
    assert streamed == sorted([*batch, (4, "FOUR"), (5, None)]) and calls == [2, 1, 2]
    aside = sorted(r.line for r in spark.read.parquet(os.path.join(d_out, "broken")).collect())
    assert aside == sorted(["{broken", '{"text": "no id"}', "[1]"])


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Files in folders: written, listed and read by tasks, the same rows as by Spark's sources; no plan holds a list of them."""
    from pyspark.sql import functions as F

    from retrieva.sources import io
    monkeypatch.setattr(io, "READ_FILES", 3)
    cells = [[None, "x,y"], ["", 'a "b"'], ["line\nbreak", "é"]]
    rows = spark.createDataFrame([(f"doc {d}", p, i, c) for d in range(7) for p in (1, 2) for i, c in enumerate(cells)], "doc_id string, page_no int, row_no long, cells array<string>")
    texts = spark.createDataFrame([(f"t{i}.txt", f"text {i} é") for i in range(20)], "name string, content string")
    flat, deep = f"file:{tmp_path}/flat", f"file:{tmp_path}/deep"
    for path, folders in ((flat, 0), (deep, 4)):
        assert io.write_table_csvs(rows, path, folders).count() == 14 and io.write_files(texts, path, folders).count() == 20
    (tmp_path / "deep" / "_hidden_table1.csv").write_text("a,b")
    assert sorted(p.name for p in (tmp_path / "deep").iterdir() if p.is_dir()) == [f"{i:05d}" for i in range(4)]
    want = sorted(io.read_table_csvs(spark, flat).select("doc_id", "page_no", "row_no", "cells").collect(), key=str)
    read = io.read_table_csvs(spark, deep, in_tasks=True)
    assert len(want) == 42 and sorted(read.select("doc_id", "page_no", "row_no", "cells").collect(), key=str) == [r for r in want]
    assert sorted(io.read_table_csvs(spark, flat, in_tasks=True).select("doc_id", "page_no", "row_no", "cells").collect(), key=str) == want
    assert sorted(r.text for r in io.read_text_files(spark, deep, in_tasks=True).collect()) == sorted(f"text {i} é" for i in range(20))
    assert {r.doc_id for r in io.read_text_files(spark, deep, in_tasks=True).collect()} == {r.doc_id for r in io.read_text_files(spark, flat).collect()}
    assert "binaryFile" not in read._jdf.queryExecution().executedPlan().toString()
    sizes = io.list_files(spark, deep, "*.txt").select(F.sum("length"), F.count(F.lit(1))).first()
    assert sizes[1] == 20 and sizes[0] == sum(len(f"text {i} é".encode()) for i in range(20))
    assert io.list_files(spark, f"{deep}/00000", "*.nothing").count() == 0
