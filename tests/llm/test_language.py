from collections import Counter, defaultdict

import numpy as np

from llm_cases import DOCS
from retrieva.llm import language, queries


def brute(docs, evidence):
    """docs: (id, text, lang, source); evidence: id -> (markup, host). Returns (language, confidence, kept) for each."""
    said = Counter(d[2] for d in docs if d[2])
    langs = sorted(x for x, n in said.items() if n >= max(language.MIN_DOCUMENTS, language.MIN_SHARE * sum(said.values())))
    classes = len(langs) + 1
    counts = np.zeros((len(langs), language.BUCKETS))
    for _, text, lang, _ in docs:
        if lang in langs and text:
            np.add.at(counts[langs.index(lang)], language.trigrams(text), 1)
    smooth = counts + 0.5 * (counts.sum(0) + 1) / (counts.sum() + language.BUCKETS) * language.BUCKETS
    logp = np.vstack([np.log((1 - language.NOISE) * smooth / smooth.sum(1, keepdims=True) + language.NOISE / language.BUCKETS), np.full(language.BUCKETS, -np.log(language.BUCKETS))]).astype(np.float32)
    rows = []
    for i, text, lang, source in docs:
        t = language.trigrams(text) if text else []
        ll = logp[:, t].sum(1, dtype=np.float64) * min(len(t), language.EFFECTIVE) / len(t) if len(t) else None
        p = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum() if ll is not None else np.zeros(classes)
        markup, host = evidence.get(i, (None, None))
        rows.append((ll, p, lang, markup, host or source))
    whole = sum((r[1] for r in rows), np.zeros(classes)) + 1
    whole[-1] = language.UNKNOWN_PRIOR * whole[:-1].sum()
    whole /= whole.sum()
    by_host, by_domain = defaultdict(lambda: np.zeros(classes)), defaultdict(lambda: np.zeros(classes))

    def domain(host):
        return ".".join(host.split(".")[-2:]) if "." in host else None
    for _, p, _, _, host in rows:
        if host is not None:
            by_host[host] += p
    for host, p in by_host.items():
        if domain(host):
            by_domain[domain(host)] += p
    out = []
    for ll, p, lang, markup, host in rows:
        if ll is None:
            out.append(("und", 0.0, False))
            continue
        prior = whole
        if host is not None:
            d = by_domain[domain(host)] if domain(host) else np.zeros(classes)
            near = (d + language.STRENGTH * whole) / (d.sum() + language.STRENGTH)
            prior = np.maximum(0, (by_host[host] - p + language.STRENGTH * near) / (by_host[host].sum() - 1 + language.STRENGTH))
        logs = ll + np.log(prior + 1e-9)
        suffix = language.SUFFIXES.get(host.rsplit(".", 1)[1].lower()) if host and "." in host else None
        for kind, said in (("declared", lang), ("markup", markup), ("suffix", suffix)):
            if said in langs:
                sure = language.RELIABLE[kind]
                logs = logs + np.log([sure if x == said else (1 - sure) / (len(langs) - 1) for x in langs] + [1 / len(langs)])
        post = np.exp(logs - logs.max())
        post /= post.sum()
        best = int(np.argmax(post))
        name = (*langs, "und")[best]
        out.append((name, post[best], bool(name != "und" and post[best] >= language.MIN_CONFIDENCE)))
    return out


def test_op3_equals_brute_force_and_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text, d.lang, d.source) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    evidence = {r.id: (r.markup, r.host) for r in language.page_evidence(spark, sf).collect()}
    assert len(evidence) > 50 and {m for m, _ in evidence.values()} <= {"de", "en", "es", "fr"}
    got = {r.doc_id: r for r in queries.op3_language_id(spark, sf).collect()}
    want = dict(zip([d[0] for d in docs], brute(docs, evidence)))
    assert len(got) == len(docs)
    for i, (name, sure, kept) in want.items():
        assert got[i].language == name and abs(got[i].confidence - sure) < 1e-4 and got[i].kept == kept
    assert np.mean([r.language == r.declared for r in got.values()]) > 0.99 and np.mean([r.kept for r in got.values()]) > 0.99


def test_text_outweighs_wrong_declarations_and_cases(spark):
    text = {"de": "der die und nicht ist ", "en": "the and of was that ", "fr": "le les des est une ", "es": "el los que una por "}
    rows = [(i, text[x] * 30, x, f"{x}.host.{'de' if x == 'de' else 'org'}") for i, x in enumerate(["de", "en", "fr", "es"] * 30)]
    rows += [(500, text["fr"] * 30, "en", "h"), (501, None, "en", "h"), (502, "", None, None), (503, "12345 !!! 99", "en", "en.host.org"), (None, text["en"] * 5, None, None),
             (504, "th", None, "de.host.de"), (0, rows[0][1], "de", rows[0][3]), (505, "zxq " * 300, None, "en.host.org"), (506, "qxjv wvkz " * 400, "xx", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS).selectExpr("*", "'x' AS language", "1 AS kept", "2 AS _p")
    decided = language.identify(df)
    got = {r._id: r for r in decided.collect()}
    want = {str(r[0]) if r[0] is not None else None: b for r, b in zip(rows, brute(rows, {}))}
    counted_twice = {"0"}  # rows equal in id and text count once
    for i, (name, sure, kept) in want.items():
        assert got[i].language == name and got[i].kept == kept and (i in counted_twice or abs(got[i].confidence - sure) < 0.02)
    assert got["500"].language == "fr" and not got["501"].kept and not got["502"].kept and not got["503"].kept
    out = language.keep_identified(df, decided)
    left = {(r.doc_id, r.lang) for r in out.collect()}
    assert out.columns == df.columns and (500, "fr") in left and (None, "en") in left and not {501, 502, 503} & {i for i, _ in left}
    assert out.filter("doc_id = 0").count() == 2
    empty = df.limit(0)
    assert language.identify(empty).count() == 0 and language.keep_identified(empty, language.identify(empty)).count() == 0


def test_classes_come_from_the_declared_languages(spark):
    text = {"de": "der die und nicht ist ", "en": "the and of was that ", "it": "gli che sono della perch\u00e9 ", "el": "\u03ba\u03b1\u03b9 \u03c4\u03bf \u03b4\u03b5\u03bd \u03b5\u03af\u03bd\u03b1\u03b9 "}
    rows = [(i, text[x] * 20, x, "h.org") for i, x in enumerate(list(text) * 20)]
    rows += [(900, text["it"] * 20, "de", "h.it"), (901, text["el"] * 20, None, None), (902, text["en"] * 20, "qq", "h.org")]
    got = {r._id: r for r in language.identify(spark.createDataFrame([(*r, 1) for r in rows], DOCS)).collect()}
    want = brute(rows, {})
    assert all(got[str(r[0])].language == w[0] and abs(got[str(r[0])].confidence - w[1]) < 1e-4 and got[str(r[0])].kept == w[2] for r, w in zip(rows, want))
    assert all(got[str(i)].kept and got[str(i)].language == x for i, _, x, _ in rows[:80])
    assert [got[i].language for i in ("900", "901", "902")] == ["it", "el", "en"]
    bare = spark.createDataFrame([(1, "some words", None, "h", 1), (2, "more words", None, None, 1)], DOCS)
    assert {(r.language, r.kept) for r in language.identify(bare).collect()} == {("und", False)}
    one = spark.createDataFrame([(i, text["it"] * 20, "it", "h", 1) for i in range(12)], DOCS)
    assert {(r.language, r.kept) for r in language.identify(one).collect()} == {("it", True)}
