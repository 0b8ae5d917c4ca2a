import random
import zlib

import numpy as np

from llm_cases import DOCS
from retrieva.llm import queries, toxicity


def test_op7_finds_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    test = [(got[i].score, t) for i, t in labels.items() if got[i].held_out]
    pos, neg = [s for s, t in test if t], [s for s, t in test if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    recall, false = np.mean([s >= 0.5 for s in pos]), np.mean([s >= 0.5 for s in neg])
    assert auc > 0.95 and recall > 0.85 and false < 0.05, (auc, recall, false)


def test_the_corrected_risk_recovers_the_classes():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    x = (rng.random((4000, 30)) < np.where(truth[:, None], 0.1, 0.1)).astype(np.float32)
    x[:, :5] = rng.random((4000, 5)) < np.where(truth[:, None], 0.6, 0.02)
    positive = truth & (rng.random(4000) < 0.5)
    rows = np.vstack([x[positive], x])
    w, b = toxicity.fit(rows, np.arange(len(rows)) < positive.sum(), 0.2)
    found = x @ w + b > 0
    assert np.mean(found[truth]) > 0.85 and np.mean(found[~truth]) < 0.05


def test_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(20)) + (" vile" if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "Vile, vile!", "en", "s", 1), (4, rows[4][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS positive", "2 AS words", "3 AS toxic")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(8, 1, 0), (None, 1, 1), (12, 1, None)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert out[None].predicted == 1 and out[None].held_out and out[1000].score == out[1001].score < 0.5
    assert all(out[i].predicted == int(i % 4 == 0) for i in range(400))
    assert toxicity.toxicity(docs, labels).filter("doc_id = 4").count() == 2
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    plain = toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()
    assert {r.predicted for r in plain} == {0}
