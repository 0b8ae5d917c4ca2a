"""URL filters: an allow/block list, and for other urls a path-template tree judged by smoothed labelled purity.

The tree of a host is built level by level from counts. Under a node, a segment stays a branch of its own only
if it is the node's one constant value, or if it is frequent and its share of bad labelled pages differs
significantly from that of its siblings (two-proportion z-test). All others, ids and rare values above all, are merged into the
wildcard ``*``. The tree has no depth limit: a level takes on only the pages whose paths go on, and a node whose pages share one
remaining path is finished at once, so the levels end where paths stop to differ. A template's purity is the share of good labelled pages,
smoothed towards the host's, itself smoothed towards the share of all pages; templates below a limit are blocked.

Everything is grouped sums and joins to their results. A host with a third of all pages is summed before the
shuffle, and the table of branches kept is joined by broadcast if its counted size allows, else by a join that Spark can split.

Cases: a null url or one without ``://`` has empty host and path and is judged with the others of the empty host;
repeated rows count each; pages without a label count in supports only; an empty table returns no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrieva.session import materialize

from .common import ascii_lower, broadcast_if_small

#: Fixed values of the contract: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Pages that a branch needs, z value of a significant difference, strength of both priors, least purity.
SUPPORT, Z, STRENGTH, PURITY = 20, 2.58, 10.0, 0.6


def host_of(url: Column) -> Column:
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(after, "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as (verdict, rule), or null. A rule's host also stands for all subdomains."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        cases.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*cases)


def _sums() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]


def kept_branches(rows: DataFrame, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """(node, seg) of the branches that aren't merged into the wildcard. rows(node, seg, n, labelled, bad)."""
    child = rows.groupBy("node", "seg").agg(*_sums())
    parent = child.groupBy("node").agg(F.count(F.lit(1)).alias("kids"), F.sum("labelled").alias("all_l"), F.sum("bad").alias("all_b"))
    c = child.join(parent, "node")
    rest_l, rest_b = F.col("all_l") - F.col("labelled"), F.col("all_b") - F.col("bad")
    p = F.col("all_b") / F.nullif("all_l", F.lit(0))
    gap = F.col("bad") / F.nullif("labelled", F.lit(0)) - rest_b / F.nullif(rest_l, F.lit(0))
    spread = F.sqrt(p * (1 - p) * (1 / F.nullif("labelled", F.lit(0)) + 1 / F.nullif(rest_l, F.lit(0))))
    constant = (F.col("kids") == 1) & is_constant(F.col("seg"))
    differs = (F.col("n") >= support) & (spread > 0) & (F.abs(gap) >= z * spread)
    return c.filter(constant | F.coalesce(differs, F.lit(False))).select("node", "seg")


def is_constant(seg: Column) -> Column:
    """A node's only segment is kept unless it begins with a digit."""
    return ~seg.rlike("^[0-9]")


def templates(pages: DataFrame, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """pages(host, path, good, ...) with ``template`` added. good: 1, 0 or null (no label).

    Under a node whose pages share one remaining path, every segment is the only one of its node, so all of it is decided at once.
    """
    rows = pages.withColumn("__ut_segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("__ut_node", F.col("host"))
    rows = materialize(rows, "url-level")
    done, on = rows.filter(F.size("__ut_segs") == 0), rows.filter(F.size("__ut_segs") > 0)
    while not on.isEmpty():
        seen = on.groupBy("__ut_node").agg(F.min("__ut_segs").alias("__ut_a"), F.max("__ut_segs").alias("__ut_b"))
        alone = materialize(seen.filter(F.col("__ut_a") == F.col("__ut_b")).select(F.col("__ut_node").alias("__ut_n")), "url-alone")
        counted = on.select(F.col("__ut_node").alias("node"), F.get("__ut_segs", F.lit(0)).alias("seg"), F.lit(1).alias("n"),
                            F.col("good").isNotNull().cast("long").alias("labelled"), F.coalesce(1 - F.col("good"), F.lit(0)).alias("bad"))
        kept = materialize(kept_branches(counted, support, z), "url-branches").select(
            F.col("node").alias("__ut_k"), F.col("seg").alias("__ut_s"), F.lit(True).alias("__ut_kept"))
        rows = on.join(broadcast_if_small(alone.withColumn("__ut_alone", F.lit(True))), F.col("__ut_node") == F.col("__ut_n"), "left")
        rows = rows.join(broadcast_if_small(kept), (F.col("__ut_node") == F.col("__ut_k")) & (F.get("__ut_segs", F.lit(0)) == F.col("__ut_s")), "left")
        whole = F.array_join(F.transform("__ut_segs", lambda s: F.when(is_constant(s), s).otherwise("*")), "/")
        step = F.when(F.col("__ut_alone"), whole).when(F.col("__ut_kept"), F.get("__ut_segs", F.lit(0))).otherwise("*")
        left = F.when(F.col("__ut_alone"), F.slice("__ut_segs", 1, 0)).otherwise(F.slice("__ut_segs", F.lit(2), F.size("__ut_segs")))
        rows = rows.withColumn("__ut_node", F.concat("__ut_node", F.lit("/"), step)).withColumn("__ut_segs", left)
        rows = materialize(rows.drop("__ut_n", "__ut_alone", "__ut_k", "__ut_s", "__ut_kept"), "url-level")
        done, on = done.unionByName(rows.filter(F.size("__ut_segs") == 0)), rows.filter(F.size("__ut_segs") > 0)
    return done.withColumn("template", F.col("__ut_node")).drop("__ut_segs", "__ut_node")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: int = SUPPORT, z: float = Z,
          strength: float = STRENGTH, purity: float = PURITY) -> DataFrame:
    """pages(url, good, ...) with host, path, template, purity, rule and verdict added (columns of these names make way). ``good`` is 1, 0 or null (no label)."""
    t = pages.drop("host", "path", "template", "purity", "rule", "verdict").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    t = materialize(templates(t, support, z), "url-templates")
    sums = materialize(t.groupBy("host", "template").agg(F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("fine")), "url-sums")
    all_good = sums.agg((F.coalesce(F.sum("fine"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).first()[0]
    by_host = sums.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("fine").alias("hf"))
    scored = sums.join(by_host, "host")
    host_good = (F.col("hf") + strength * all_good) / (F.col("hl") + strength)
    scored = materialize(scored.select(F.col("template").alias("__ut_t"), ((F.col("fine") + strength * host_good) / (F.col("labelled") + strength)).alias("__ut_p")), "url-purity")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    out = t.join(broadcast_if_small(scored), F.col("template") == F.col("__ut_t")).drop("__ut_t").withColumnRenamed("__ut_p", "purity").withColumn("__ut_r", rule)
    verdict = F.coalesce(F.col("__ut_r.verdict"), F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return out.withColumn("rule", F.col("__ut_r.rule")).withColumn("verdict", verdict).drop("__ut_r")


def oracle_sql() -> str:
    """DuckDB SQL of the registered query: the same levels, by recursion over the pages whose paths go on."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    steps = [f"""a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
g AS (SELECT doc_id, min(quality * (1 - toxic)) AS good FROM labels GROUP BY doc_id),
r0 AS (SELECT page_id, host, path, good, host AS node, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM (
  SELECT page_id, good, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{lower}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM a LEFT JOIN g ON g.doc_id = try_cast(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1) AS BIGINT))),
r AS (SELECT page_id, host, path, good, node, segs, 0 AS k FROM r0
 UNION ALL
 SELECT page_id, host, path, good, node || '/' || CASE WHEN kids = 1 AND NOT regexp_matches(seg, '^[0-9]')
     OR coalesce(n >= {SUPPORT} AND sqrt(p * (1 - p) * inv) > 0 AND abs(gap) >= {Z} * sqrt(p * (1 - p) * inv), false) THEN seg ELSE '*' END, segs, k + 1
 FROM (SELECT *, max(nth) OVER (PARTITION BY node) AS kids, ab / nullif(al, 0) AS p, b / nullif(l, 0) - (ab - b) / nullif(al - l, 0) AS gap,
              1 / nullif(l, 0) + 1 / nullif(al - l, 0) AS inv
  FROM (SELECT *, dense_rank() OVER (PARTITION BY node ORDER BY seg) AS nth, count(*) OVER (PARTITION BY node, seg) AS n,
               count(good) OVER (PARTITION BY node, seg) AS l, coalesce(sum(1 - good) OVER (PARTITION BY node, seg), 0) AS b,
               count(good) OVER (PARTITION BY node) AS al, coalesce(sum(1 - good) OVER (PARTITION BY node), 0) AS ab
   FROM (SELECT *, segs[k + 1] AS seg FROM r WHERE len(segs) > k))))"""]
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN '{verdict} {rule}'")
    return "WITH RECURSIVE " + ",\n".join(steps) + f""",
t AS (SELECT *, node AS template FROM r WHERE len(segs) = k),
ts AS (SELECT host, template, count(good) AS l, coalesce(sum(good), 0) AS f FROM t GROUP BY ALL),
hs AS (SELECT host, sum(l) AS hl, sum(f) AS hf FROM ts GROUP BY host),
al AS (SELECT (coalesce(sum(f), 0) + 1) / (coalesce(sum(l), 0) + 2) AS share FROM ts),
pu AS (SELECT template, (f + {STRENGTH} * ((hf + {STRENGTH} * (SELECT share FROM al)) / (hl + {STRENGTH}))) / (l + {STRENGTH}) AS purity FROM ts JOIN hs USING (host)),
j AS (SELECT page_id, host, path, template, purity, CASE {' '.join(cases)} END AS fit FROM t JOIN pu USING (template))
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 6) AS purity FROM j"""
