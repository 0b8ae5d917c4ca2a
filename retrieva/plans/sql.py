"""Independent DuckDB SQL for the oracle check (written by hand, not derived
from the Spark plans). Shared fragments are plain SQL text."""

from __future__ import annotations

from ..functions.stopwords import sql_list
from ..operators.corpus import IRREGULAR_NOUNS

STOP = "[" + sql_list() + "]"

# White space as in Python's str.split(), for both engines (RE2's own class is ASCII only).
SPACE = r"\p{Z}\x09-\x0d\x1c-\x1f\x{85}"


def unicode_space(sql: str) -> str:
    """The short classes of the SQL below, spelled out."""
    return sql.replace(r"[.!?\s]", f"[.!?{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")

# corpus: documents with a non-blank text, name = source_docid, content prefixed
DOCS = r"""docs0 AS (
  SELECT doc_id, source, source || '_' || CAST(doc_id AS VARCHAR) AS name,
         translate(source || '_' || CAST(doc_id AS VARCHAR), '_-', '  ') || chr(10) || chr(10)
           || regexp_replace(text, '^\s+|\s+$', '', 'g') AS content,
         text
  FROM documents WHERE regexp_matches(text, '\S')),
docs AS (
  SELECT *, CASE WHEN content = '' THEN 'Untitled' ELSE split_part(content, chr(10), 1) END AS title,
         CAST(len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS BIGINT) AS length
  FROM docs0)"""


def kept_tokens(text_expr: str) -> str:
    """Lower-cased 2+ character word tokens without stop words (as a list)."""
    return (f"list_filter(regexp_extract_all(lower({text_expr}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda x: NOT list_contains({STOP}, x))")


def ngrams(t: str) -> str:
    """1-, 2- and 3-grams of the token list expression ``t`` (space-joined)."""
    return (f"({t} || list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
            f" || list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]))")


TFIDF = DOCS + r""",
dtok AS (SELECT doc_id, """ + kept_tokens("content") + r""" AS t FROM docs),
terms AS (SELECT doc_id, unnest(""" + ngrams("t") + r""") AS term FROM dtok),
n AS (SELECT count(*) AS n FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM tf GROUP BY term
          ORDER BY ctf DESC, term ASC LIMIT 10000),
idf AS (SELECT term, df, ctf, ln((1 + (SELECT n FROM n)) / (1 + df)) + 1 AS idf FROM vocab),
w AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
post AS (SELECT term, doc_id, w / norm AS score FROM w JOIN nrm USING (doc_id)),
qtok AS (SELECT item_id AS query_id, """ + kept_tokens("text") + r""" AS t FROM benchmark),
qterms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(""" + ngrams("t") + r""") AS term FROM qtok)
           WHERE term IN (SELECT term FROM vocab)),
sparse AS (SELECT query_id, doc_id, sum(score) AS score FROM qterms JOIN post USING (term)
           GROUP BY query_id, doc_id)"""

VECTORS = r"""dv AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
         WHERE vec_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '\S'))),
qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
       WHERE vec_id IN (SELECT item_id FROM benchmark)),
dense_all AS (SELECT qv.query_id, dv.doc_id, list_dot_product(qv.v, dv.v) AS score FROM qv, dv)"""


def dense_topk(k: int) -> str:
    return f"""dense AS (SELECT query_id, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rn
    FROM dense_all) WHERE rn <= {k})"""


def hybrid(k: int, alpha: float) -> str:
    return f"""smax AS (SELECT query_id, max(score) AS mx FROM sparse GROUP BY query_id),
sn AS (SELECT s.query_id, s.doc_id, s.score / coalesce(nullif(m.mx, 0), 1) AS sn FROM sparse s JOIN smax m USING (query_id)),
fused AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id,
                 {alpha} * coalesce(d.score, 0) + {1 - alpha} * coalesce(s.sn, 0) AS combined_score
          FROM dense d FULL OUTER JOIN sn s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined_score, 6) DESC, doc_id) AS rank
        FROM fused) WHERE rank <= {k})"""

PAIRS = r"""pu AS (SELECT conv_id, turn, text AS reference FROM conversations WHERE role = 'user'),
pa AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT conv_id, turn, reference, answer FROM pu JOIN pa USING (conv_id, turn)),
valid AS (SELECT * FROM pairs WHERE answer IS NOT NULL AND reference IS NOT NULL
          AND regexp_matches(answer, '\S') AND regexp_matches(reference, '\S')),
btok AS (SELECT conv_id, turn, answer, reference,
                list_filter(string_split_regex(answer, '[.!?\s]+'), lambda x: x <> '') AS h,
                list_filter(string_split_regex(reference, '[.!?\s]+'), lambda x: x <> '') AS r FROM valid),
bp AS (SELECT * FROM btok WHERE len(h) > 0 AND len(r) > 0)"""


def rouge_sents(x: str) -> str:
    return (f"list_transform(list_filter(string_split({x}, '.'), lambda s: length(s) > 0), "
            f"lambda s: array_to_string(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> ''), ' '))")


def rouge_words(sents: str) -> str:
    return f"flatten(list_transform({sents}, lambda s: string_split(s, ' ')))"


ROUGE = PAIRS + r""",
rs0 AS (SELECT conv_id, turn, """ + rouge_sents("answer") + r""" AS hs, """ + rouge_sents("reference") + r""" AS rs FROM valid),
rp AS (SELECT conv_id, turn, hs, rs, """ + rouge_words("hs") + r""" AS hw, """ + rouge_words("rs") + r""" AS rw
       FROM rs0 WHERE len(hs) > 0 AND len(rs) > 0)"""


# One LCS of each sentence pair by table and trace-back (up when the upper cell is strictly larger, else left),
# the distinct words of all of them for each pair.
ROUGE_L = ROUGE + r""",
sp AS (SELECT conv_id, turn, string_split(r, ' ') AS a, string_split(h, ' ') AS b
       FROM (SELECT conv_id, turn, r, unnest(hs) AS h FROM (SELECT conv_id, turn, hs, unnest(rs) AS r FROM rp))),
tb AS (SELECT conv_id, turn, a, b, list_reduce(a, lambda tab, x: list_append(tab,
         list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN x = b[j] THEN tab[len(tab)][j] + 1
           ELSE greatest(tab[len(tab)][j + 1], acc[j]) END), [0])), [list_transform(range(0, len(b) + 1), lambda z: 0)]) AS t FROM sp),
wd AS (SELECT conv_id, turn, list_reduce(range(0, len(a) + len(b)), lambda st, k:
         CASE WHEN st.i = 0 OR st.j = 0 THEN st
              WHEN a[st.i] = b[st.j] THEN {'i': st.i - 1, 'j': st.j - 1, 'w': list_append(st.w, a[st.i])}
              WHEN t[st.i][st.j + 1] > t[st.i + 1][st.j] THEN {'i': st.i - 1, 'j': st.j, 'w': st.w}
              ELSE {'i': st.i, 'j': st.j - 1, 'w': st.w} END,
         {'i': CAST(len(a) AS BIGINT), 'j': CAST(len(b) AS BIGINT), 'w': CAST([] AS VARCHAR[])}).w AS w FROM tb),
ul AS (SELECT conv_id, turn, count(DISTINCT x) AS ulcs FROM (SELECT conv_id, turn, unnest(w) AS x FROM wd) GROUP BY ALL),
rl AS (SELECT len(list_distinct(hw)) AS n, len(list_distinct(rw)) AS m, coalesce(ulcs, 0) AS u FROM rp LEFT JOIN ul USING (conv_id, turn))"""


def bigrams(w: str) -> str:
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


def lcs_len(a: str, b: str) -> str:
    """LCS length by a row-by-row dynamic program (nested list_reduce)."""
    return (f"list_reduce({a}, lambda prev, x: list_reduce(range(1, len({b}) + 1), lambda acc, j: "
            f"list_append(acc, CASE WHEN x = {b}[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0]), "
            f"list_transform(range(0, len({b}) + 1), lambda z: 0))[len({b}) + 1]")

TABLE_ROWS_SQL = r"""trows AS (
  SELECT DISTINCT 'cust' || CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey % PAGES AS INTEGER) AS page_no, CAST(0 AS BIGINT) AS row_no,
         ['orderkey', 'status', 'priority'] AS cells FROM orders
  UNION ALL
  SELECT 'cust' || CAST(o_custkey AS VARCHAR), CAST(o_orderkey % PAGES AS INTEGER), o_orderkey + 1,
         CASE WHEN o_orderstatus = 'P' THEN CAST([NULL, NULL, NULL] AS VARCHAR[])
              ELSE [CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority] END FROM orders),
urows AS (SELECT * FROM trows WHERE len(list_filter(cells, lambda c: c IS NOT NULL AND trim(c) <> '')) > 0),
keep AS (SELECT doc_id, page_no FROM urows WHERE row_no <> 0 GROUP BY ALL HAVING count(*) > 1),
kept AS (SELECT * FROM urows WHERE (doc_id, page_no) IN (SELECT (doc_id, page_no) FROM keep)),
ncol AS (SELECT doc_id, page_no, max(len(cells)) AS nc FROM kept GROUP BY ALL),
kj AS (SELECT k.*, j FROM kept k JOIN ncol USING (doc_id, page_no), unnest(range(1, ncol.nc + 1)) AS u(j)),
cw AS (SELECT doc_id, page_no, j, max(length(coalesce(cells[j], 'NaN'))) AS w FROM kj GROUP BY ALL),
lines AS (SELECT doc_id, page_no, row_no, string_agg(lpad(coalesce(cells[j], 'NaN'), CAST(w AS INTEGER), ' '), ' ' ORDER BY j) AS line
          FROM kj JOIN cw USING (doc_id, page_no, j) GROUP BY ALL),
rendered AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY row_no) AS table_text FROM lines GROUP BY ALL)"""

def table_rows(pages: int = 1) -> str:
    """Table rows of each customer, dealt over ``pages`` pages by order key, and the steps up to rendered tables."""
    return TABLE_ROWS_SQL.replace("PAGES", str(pages))


TABLE_ROWS = table_rows()


def clean_tokens(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({x}, '\\s+'), "
            f"lambda w: regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), "
            f"lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$'))")


def cleaned(src: str) -> str:
    """T1 over a CTE ``src(doc_id, text)``: CTEs occ, lex, cand, lem, cleaned."""
    return f"""ct AS (SELECT doc_id, {clean_tokens('text')} AS t FROM {src}),
occ AS (SELECT doc_id, pos, t[pos] AS tok FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS pos FROM ct)
        WHERE NOT list_contains({STOP}, t[pos])),
lex AS (SELECT DISTINCT tok FROM occ),
rules AS (SELECT * FROM (VALUES (1, 's', ''), (2, 'ses', 's'), (3, 'ves', 'f'), (4, 'xes', 'x'), (5, 'zes', 'z'),
          (6, 'ches', 'ch'), (7, 'shes', 'sh'), (8, 'men', 'man'), (9, 'ies', 'y')) r(o, suf, rep)),
cand AS (SELECT lex.tok, o, left(lex.tok, length(lex.tok) - length(suf)) || rep AS c FROM lex, rules
         WHERE ends_with(lex.tok, suf)),
lem AS (SELECT tok, first(c ORDER BY length(c), o) AS lemma FROM cand WHERE c IN (SELECT tok FROM lex) GROUP BY tok),
lem2 AS (SELECT * FROM lem),
cl AS (SELECT doc_id, string_agg(coalesce(lem2.lemma, occ.tok), ' ' ORDER BY pos) AS cleaned
       FROM occ LEFT JOIN lem2 USING (tok) GROUP BY doc_id),
cleaned AS (SELECT s.doc_id, coalesce(cl.cleaned, '') AS cleaned FROM {src} s LEFT JOIN cl USING (doc_id))"""

# The stand-in lexicon: neighbouring words of the questions, and the irregular nouns (fixed values); of several lemmas the shortest, then the first.
IRREGULAR = ", ".join(f"('{form}', '{lemma}')" for form, lemma in IRREGULAR_NOUNS)
LEXICON = r"""bw AS (SELECT string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM benchmark),
lexrows AS (SELECT w[i] AS form, w[i + 1] AS lemma FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bw) WHERE w[i] <> '' AND w[i + 1] <> ''
            UNION ALL SELECT * FROM (VALUES """ + IRREGULAR + r""") v(form, lemma)),
lexicon AS (SELECT form, first(lemma ORDER BY length(lemma), lemma) AS lemma FROM lexrows GROUP BY form)"""

# The two prompt wordings, as SQL text.
PROMPT1_HEAD = "'Use the following context to answer the question concisely and clearly.' || chr(10) || chr(10) || 'Context:' || chr(10)"
PROMPT2_HEAD = "'Use the following context to answer the question as concisely and clearly as possible.' || chr(10) || chr(10) || 'Context:' || chr(10)"


def prompt_sql(head: str, context: str, question: str) -> str:
    return f"({head} || {context} || chr(10) || chr(10) || 'Question:' || chr(10) || {question} || chr(10))"


BM25 = r"""bd AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS t FROM documents),
bn AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM bd),
btf AS MATERIALIZED (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM bd) GROUP BY ALL),
bdf AS MATERIALIZED (SELECT term, count(*) AS df FROM btf GROUP BY term),
braw AS MATERIALIZED (SELECT term, ln((SELECT n FROM bn) - df + 0.5) - ln(df + 0.5) AS raw FROM bdf),
bidf AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM braw) ELSE raw END AS idf FROM braw),
bq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id,
         unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM bn)))) AS score
       FROM bq JOIN bidf USING (term) JOIN btf USING (term) GROUP BY ALL),
bm4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
        FROM bm WHERE score > 0) WHERE rank <= 4)"""

DENSE_L2 = r"""dv2 AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE vec_id IN (SELECT doc_id FROM documents)),
qv2 AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
l2all AS (SELECT qv2.query_id, dv2.doc_id,
                 list_sum(list_transform(range(1, len(qv2.v) + 1), lambda i: (qv2.v[i] - dv2.v[i]) * (qv2.v[i] - dv2.v[i]))) AS score
          FROM qv2, dv2),
l2top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) ASC, doc_id) AS rank
          FROM l2all) WHERE rank <= 5)"""

FUSE2 = r"""keyed AS (SELECT doc_id, md5(text) AS content_key, text FROM documents),
fd AS (SELECT query_id, content_key, min(0.5 * (1.0 / (1.0 + score))) AS d, min(doc_id) AS d_id
       FROM l2top JOIN keyed USING (doc_id) GROUP BY ALL),
fs AS (SELECT query_id, content_key, count(*) * 0.5 AS s, min(doc_id) AS s_id FROM bm4 JOIN keyed USING (doc_id) GROUP BY ALL),
fused2 AS (SELECT coalesce(fd.query_id, fs.query_id) AS query_id, coalesce(fd.content_key, fs.content_key) AS content_key,
                  least(fd.d_id, fs.s_id) AS doc_id, coalesce(fd.d, 0) + coalesce(fs.s, 0) AS fused_score
           FROM fd FULL OUTER JOIN fs ON fd.query_id = fs.query_id AND fd.content_key = fs.content_key),
ranked2 AS (SELECT f.*, k.text, row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.fused_score, 6) DESC, f.doc_id) AS rank
            FROM fused2 f JOIN keyed k ON k.doc_id = f.doc_id),
packed AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY query_id ORDER BY rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM ranked2),
ctx2 AS (SELECT q.query_id, coalesce(string_agg(p.text || chr(10) || chr(10), '' ORDER BY p.rank), '') AS context,
                count(p.rank) AS n_docs
         FROM (SELECT DISTINCT query_id FROM ranked2) q LEFT JOIN packed p ON p.query_id = q.query_id AND p.pre + length(p.text) < 3000
         GROUP BY q.query_id)"""

IVF = r"""iv AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE vec_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '\S'))),
nl AS (SELECT greatest(1, least(count(*) // 10, 100)) AS nlist FROM iv),
cent AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS cell_id, v AS c FROM iv
         ORDER BY doc_id LIMIT (SELECT nlist FROM nl)),
asg AS (SELECT doc_id, v, cell_id FROM (SELECT iv.doc_id, iv.v, cent.cell_id,
          row_number() OVER (PARTITION BY iv.doc_id ORDER BY round(list_dot_product(iv.v, cent.c), 6) DESC, cent.cell_id) AS rn
        FROM iv, cent) WHERE rn = 1),
iq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
probe AS (SELECT query_id, cell_id FROM (SELECT iq.query_id, cent.cell_id,
            row_number() OVER (PARTITION BY iq.query_id ORDER BY round(list_dot_product(iq.v, cent.c), 6) DESC, cent.cell_id) AS rn
          FROM iq, cent) WHERE rn <= 1),
ivf AS (SELECT * FROM (SELECT p.query_id, a.doc_id, list_dot_product(iq.v, a.v) AS score,
          row_number() OVER (PARTITION BY p.query_id ORDER BY round(list_dot_product(iq.v, a.v), 6) DESC, a.doc_id) AS rank
        FROM probe p JOIN iq USING (query_id) JOIN asg a ON a.cell_id = p.cell_id) WHERE rank <= 5)"""
