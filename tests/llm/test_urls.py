import math
import re
from collections import defaultdict

import pytest

from retrieva.llm import queries, urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def fitting(host, path):
    best = None
    for verdict, rule in RULES:
        name, start = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def brute(pages, support=urls.SUPPORT, z=urls.Z, strength=urls.STRENGTH, purity=urls.PURITY):
    """pages: (page_id, url, good) -> {index: (host, path, rule, verdict, template)}"""
    rows = [dict(zip(("host", "path"), parts(u)), good=g) for _, u, g in pages]
    for r in rows:
        r["segs"], r["node"] = [s for s in r["path"].split("/") if s], r["host"]
    for level in range(max((len(r["segs"]) for r in rows), default=0)):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for r in rows:
            if len(r["segs"]) > level:
                c = kids[r["node"]][r["segs"][level]]
                c[0] += 1
                c[1] += r["good"] is not None
                c[2] += r["good"] == 0
        for r in rows:
            if len(r["segs"]) <= level:
                r["step"] = ""
                continue
            seg = r["segs"][level]
            family = kids[r["node"]]
            n, lab, bad = family[seg]
            all_l, all_b = sum(c[1] for c in family.values()), sum(c[2] for c in family.values())
            keep = len(family) == 1 and not re.match("[0-9]", seg)
            if not keep and n >= support and lab and all_l > lab:
                p = all_b / all_l
                spread = math.sqrt(p * (1 - p) * (1 / lab + 1 / (all_l - lab)))
                keep = spread > 0 and abs(bad / lab - (all_b - bad) / (all_l - lab)) >= z * spread
            r["step"] = "/" + (seg if keep else "*")
        for r in rows:
            r["node"] += r["step"]
    for r in rows:
        r["template"] = r["node"]
    lab, fine, hl, hf = (defaultdict(int) for _ in range(4))
    for r in rows:
        if r["good"] is not None:
            lab[r["template"]] += 1
            fine[r["template"]] += r["good"]
            hl[r["host"]] += 1
            hf[r["host"]] += r["good"]
    overall = (sum(fine.values()) + 1) / (sum(lab.values()) + 2)
    out = []
    for r in rows:
        near = (hf[r["host"]] + strength * overall) / (hl[r["host"]] + strength)
        p = (fine[r["template"]] + strength * near) / (lab[r["template"]] + strength)
        rule = fitting(r["host"], r["path"])
        out.append((r["host"], r["path"], rule and rule[1], rule[0] if rule else ("block" if p < purity else "allow"), r["template"], round(p, 9)))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op8_equals_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    pages = queries.labelled_pages(spark, folder).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, r.purity) for r in queries.op8_url_filters(spark, folder).collect()}
    assert len(got) == len(pages)
    want = brute([(p.page_id, p.url, p.good) for p in pages])
    assert got == {p.page_id: (*w[:5], round(w[5], 6)) for p, w in zip(pages, want)}


def test_templates_and_cases(spark):
    rows = [(i, f"http://Shop.Example.NET/spam/{i}/x?q", 0) for i in range(60)] + [(100 + i, f"http://shop.example.net/news/{i}", 1) for i in range(60)]
    rows += [(200 + i, f"http://shop.example.net/{'ab'[i % 2]}/{i}", i % 2) for i in range(10)]
    rows += [(300, None, None), (301, "no scheme", 1), (302, "ftp://x.org", None), (303, "http://a.org/es/1", 0), (304, "http://example.org/es/1", 1), (305, "http://b.com/de/", 1),
             (306, "http://h/a/b/c/d/e/f#x", None), (306, "http://h/a/b/c/d/e/f#x", None), (307, "x://y://z/w", 1), (None, "http://notexample.org/en/1", 0), (308, "http://com/fr/", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, good bigint").selectExpr("*", "'t' AS n", "1 AS labelled")
    got = sorted(urls.judge(df).collect(), key=lambda r: (r.page_id is None, r.page_id))
    want = dict(zip([(r[0] is None, r[0], r[1]) for r in rows], brute(rows)))
    for r in got:
        assert (r.host, r.path, r["rule"], r.verdict, r.template, round(r.purity, 9)) == want[(r.page_id is None, r.page_id, r.url)]
    by = {r.page_id: r for r in got}
    assert by[0].template == "shop.example.net/spam/*/x" and by[0].verdict == "block" and by[100].verdict == "allow"
    assert by[306].template == "h/a/b/c/d/e/f" and by[303]["rule"] == "org/" and by[304]["rule"] == "example.org/es/"
    assert len(got) == len(rows) and urls.judge(df.limit(0)).count() == 0


def test_branches_below_the_fourth_segment_are_judged_apart(spark):
    rows = [(i, f"http://h.net/2024/05/12/news/{'spam' if i % 2 else 'town'}/{i}/x/{'ab'[i % 3 == 0]}/7/end", 1 - i % 2) for i in range(120)]
    rows += [(500 + i, "http://h.net/" + "/".join(f"s{k}" if k % 9 else str(k) for k in range(400)), 1) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, good bigint").selectExpr("*", "0.5 AS purity", "'r' AS rule")
    want = dict(zip([r[0] for r in rows], brute(rows)))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert all((r.template, r.verdict, round(r.purity, 9)) == (want[i][4], want[i][3], want[i][5]) for i, r in got.items()) and len(got) == len(rows)
    assert {got[i].verdict for i in range(1, 120, 2)} == {"block"} and {got[i].verdict for i in range(0, 120, 2)} == {"allow"}
