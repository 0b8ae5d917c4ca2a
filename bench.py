"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs its whole plan into the ``noop`` sink, so nothing is collected to the driver. Builds and searches are timed
apart: ``build_*`` makes and saves an index, and the searches that follow load it from disk. Shared storage is a fresh folder, named
to Spark as a cluster would. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retrieva.plans import catalog  # noqa: E402
from retrieva.session import build_session  # noqa: E402

BUILDS = {"build_tfidf": catalog._tfidf, "build_bm25": catalog._bm25, "build_cells": catalog._cells}
HEADLINE = [
    "a5_inverted_index",     # TF-IDF index (1-3 grams, 10k vocabulary), not saved
    "a6_sparse_search",      # every question against the saved index
    "w2_sparse_ranking",
    "w1_dense_topk",         # exact dense top-5 (blocked, no cross join)
    "w3_hybrid_topk",
    "a10_bm25_search",
    "v4_ivf_search",         # one probed cell of the saved index
    "v2_train_cells",
    "w6_pack_context",       # variant-2 retrieval + context packing
    "u3_batch_answer",
    "u4_batch_answer",
    "o1_union_corpus",
    "t1_clean_text",
    "e1_corpus_bleu",
    "e2_rouge_n",
    "e3_rouge_l_summary",
    "e4_rouge_l_lcs",
    "e5_greedy_match",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or [*BUILDS, *HEADLINE]
    spark = build_session(f"local[{cpus}]", cpus, app_name="retrieva-bench",
                          extra={"spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="retrieva-bench-")})
    timings = {}
    for name in names:
        t0 = time.time()
        if name in BUILDS:
            BUILDS[name](spark, sf_dir)
        else:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
