import hashlib
import random
import subprocess
import sys

import numpy as np
from test_bpe import library
from test_language import brute as brute_languages
from test_lines import expect as brute_lines
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from llm_cases import DOCS
from retrieva.llm import language, mixing


def test_the_pipeline_equals_the_composed_brute_force(spark, write_tables):
    """Stages 1 to 3 and 5 against brute force; stage 4's rows against mix() on its own input, which test_mixing checks."""
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text, d.lang, d.source) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    evidence = {r.id: (r.markup, r.host) for r in language.page_evidence(spark, sf).collect()}
    kept = [(i, t, b[0], s) for (i, t, _, s), b in zip(docs, brute_languages(docs, evidence)) if b[2]]
    kept = [(i, c[0], x, s) for (i, _, x, s), c in zip(kept, brute_lines([(d[0], d[1]) for d in kept]))]
    component = brute_components([d[0] for d in kept], [brute_fingerprint(d[1]) for d in kept])
    kept = [d for d in kept if component[d[0]] == d[0]]
    df = spark.createDataFrame([(*d, len(d[1])) for d in kept], DOCS)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(df).collect() if r.size}
    enc, want = library(), []
    for i, t, x, s in kept:
        ids = np.array(enc.encode_ordinary(t), "<u4")
        row = (i, x, s, len(ids), ids.tobytes(), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want += [row] * taken.get(i, 0)
    got = [(*r[:4], bytes(r.ids), *r[5:]) for r in corpus_pipeline.run(spark, sf).collect() if r.n_tokens]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_every_stage_takes_nulls_repeats_extra_columns_and_empty_tables(spark, write_tables):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "and", "with", "that", "of", "thing", "is"]) + str(i % 3) * (i % 2) for _ in range(60)), "en", f"s{i % 3}", 300) for i in range(30)]
    rows += [(3, rows[3][1], "en", "s0", 300), (40, None, None, None, None), (41, "", "en", "s0", 0), (None, "the and with that " * 20, None, None, 9), (42, "the and of " * 30000, "en", "s1", 330000)]
    docs = spark.createDataFrame(rows, DOCS)
    pages = spark.createDataFrame([(1, "http://a.org/en/3", '<html lang="en">'), (None, None, None), (2, "http://b.org/4", "")], "page_id bigint, url string, html string")
    folder = write_tables(documents=docs, pages=pages)
    for extra in (docs, docs.selectExpr("*", "1 AS _h", "2 AS fp", "3 AS size", "4 AS ids", "5 AS hash"), docs.limit(0)):
        cur = extra
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, cur, folder)
            n = out.count()
            if name != "bpe":
                assert out.columns == extra.columns
                cur = out
        assert (n > 0) == (extra is not extra.limit(0) and cur.count() > 0)


def test_entry_works_without_the_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("retrieva.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=120)


def test_all_queries_of_operators_are_registered():
    import __spark_entry__ as e

    names = [q for q in e.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in e.queries()
