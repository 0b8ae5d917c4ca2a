"""Registered queries that go through files (S2-S5, K1-K3, K5, K6, P9, Q1, E6 from files): a table is written to a fresh folder in shared
storage by the library's sinks, read back by its sources, and the rows read are the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer as AN
from ..operators import corpus as CO
from ..operators import evaluate as EV
from ..operators import tables as TB
from ..session import materialize, scratch_path
from ..sources import io
from ..streaming.stream import answer_stream
from . import bindings as B
from . import sql as S
from .catalog import ANSWERS, CTX1, HYB3, ORACLE, PAIR_KEYS, _contexts_v1, query, r6

#: Texts that ISO-8859-1 can hold and that aren't plain ASCII; line ends that CSV readers unify are left out.
LATIN = "^[\\x00-\\xFF]*[\\x80-\\xFF][\\x00-\\xFF]*$"


def _questions_and_answers(spark, sf_dir):
    """(query, answer, latin): user texts and the assistant's next ones; ``latin`` pairs go to ISO-8859-1 files."""
    p = B.pairs(spark, sf_dir).select(F.col("reference").alias("query"), "answer").na.drop()
    one = F.concat("query", "answer")
    return p.withColumn("latin", one.rlike(LATIN))


def _write_mixed(spark, sf_dir) -> str:
    """Question files in two encodings under one folder, as K2 writes them."""
    d = scratch_path(spark, "qa-files")
    p = materialize(_questions_and_answers(spark, sf_dir), "qa")
    io.write_qa_csv(p.filter("latin").select("query", "answer"), f"{d}/latin", encoding="ISO-8859-1")
    io.write_qa_csv(p.filter("NOT latin").select("query", "answer"), f"{d}/utf8")
    return d


QA_PAIRS = r"""qa AS (SELECT u.text AS query, a.text AS answer, regexp_full_match(u.text || a.text, '[\x00-\x{FF}]*[\x80-\x{FF}][\x00-\x{FF}]*', 's') AS latin
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
WHERE u.text IS NOT NULL AND a.text IS NOT NULL)"""


@query("s4_qa_files", f"WITH {QA_PAIRS} SELECT query, answer, count(*) AS n FROM qa GROUP BY query, answer")
def s4_qa_files(spark, sf_dir):
    """S3 + S4 + K2: question files in two encodings, each decoded by its own, whole texts compared."""
    d = _write_mixed(spark, sf_dir)
    both = io.read_qa_csv(spark, f"{d}/latin", io.ANSWER_SCHEMA).unionByName(io.read_qa_csv(spark, f"{d}/utf8", io.ANSWER_SCHEMA))
    return both.groupBy("query", "answer").agg(F.count(F.lit(1)).alias("n"))


@query("s3_file_encodings", f"""WITH {QA_PAIRS} SELECT DISTINCT CASE WHEN latin THEN 'latin' ELSE 'utf8' END AS folder,
CASE WHEN latin THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding FROM qa""")
def s3_file_encodings(spark, sf_dir):
    """S3: the encoding found for the files of each folder."""
    d = _write_mixed(spark, sf_dir)
    found = [io.file_encodings(spark, f"{d}/{x}", "*.csv").select(F.lit(x).alias("folder"), "encoding") for x in ("latin", "utf8")]
    return found[0].unionByName(found[1]).distinct()


@query("k1_append_log", f"WITH {QA_PAIRS} SELECT query, answer, count(*) AS n FROM qa GROUP BY query, answer")
def k1_append_log(spark, sf_dir):
    """K1: a CSV log that grows by two appends, each part with its header, read back as one."""
    p = materialize(_questions_and_answers(spark, sf_dir), "qa")
    d = scratch_path(spark, "log")
    for part in (p.filter("length(query) % 2 = 0"), p.filter("length(query) % 2 = 1")):
        io.append_log(part.select("query", "answer"), d, "csv")
    return io.read_qa_csv(spark, d, io.ANSWER_SCHEMA).groupBy("query", "answer").agg(F.count(F.lit(1)).alias("n"))


@query("s2_table_files", f"""WITH {S.table_rows(2)} SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY row_no) - 1 AS BIGINT) AS row_no,
array_to_string(list_transform(cells, lambda c: coalesce(c, 'NaN')), '|') AS cells FROM trows""")
def s2_table_files(spark, sf_dir):
    """S2 + K6 as files: one CSV file for each table, read back by file name, every row with its place in the file."""
    d = scratch_path(spark, "table-files")
    io.write_table_csvs(B.table_rows(spark, sf_dir, pages=2), d, io.FOLDERS)
    rows = io.read_table_csvs(spark, d, in_tasks=True)
    return rows.select("doc_id", "page_no", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "|", "NaN").alias("cells"))


@query("o1_corpus_from_files", f"""WITH {S.DOCS}, {S.table_rows(1)},
td AS (SELECT doc_id || '_table' || CAST(page_no AS VARCHAR) AS id, table_text FROM rendered),
tdocs AS (SELECT id AS doc_id, translate(id, '_-', '  ') || chr(10) || chr(10) || table_text AS content FROM td),
u AS (SELECT name AS doc_id, content FROM docs UNION ALL SELECT doc_id, content FROM tdocs)
SELECT doc_id, md5(content) AS content_md5 FROM u""")
def o1_corpus_from_files(spark, sf_dir):
    """S1 + S2 + O1 from files: text files and table files in one folder become one corpus."""
    d = scratch_path(spark, "corpus-files")
    texts = B.documents(spark, sf_dir).select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    io.write_files(texts, d, io.FOLDERS)
    io.write_table_csvs(B.table_rows(spark, sf_dir), d, io.FOLDERS)
    tables = TB.table_documents(TB.render_tables(TB.keep_tables(io.read_table_csvs(spark, d, in_tasks=True))))
    return CO.union_corpus(io.scan_text_corpus(spark, d, in_tasks=True), tables).select("doc_id", F.md5("content").alias("content_md5"))


@query("s5_raw_documents", r"""WITH k AS (SELECT page_id, html, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'jpeg' ELSE 'html' END AS suffix FROM pages)
SELECT 'page' || CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN suffix = 'pdf' THEN 'pdf' ELSE 'image' END AS kind, CAST(octet_length(encode(html)) AS BIGINT) AS length FROM k WHERE suffix <> 'html'""")
def s5_raw_documents(spark, sf_dir):
    """A folder of files of several kinds, listed and dispatched by suffix without reading them (the files hold the pages' bytes)."""
    d = scratch_path(spark, "raw-documents")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "jpg", "png", "jpeg", "html")]), (F.col("page_id") % 5 + 1).cast("int"))
    files = B.table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("."), suffix).alias("name"), F.col("html").alias("content"))
    io.write_files(files, d)
    return io.list_raw_documents(spark, d).select("doc_id", "kind", F.col("length").cast("long").alias("length"))


@query("k5_cleaned_files", f"""WITH src AS (SELECT doc_id, text FROM documents), {S.cleaned('src')} SELECT doc_id, md5(cleaned) AS content_md5 FROM cleaned""")
def k5_cleaned_files(spark, sf_dir):
    """K5: cleaned texts written, and read back."""
    d = scratch_path(spark, "cleaned")
    io.write_cleaned(CO.clean_text(B.documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("cleaned", "content"), d)
    return spark.read.parquet(d).select("doc_id", F.md5("content").alias("content_md5"))


@query("k6_table_rows", f"""WITH {S.table_rows(3)} SELECT doc_id || '_table' || CAST(page_no AS VARCHAR) AS table_name, row_no, array_to_string(list_transform(cells, lambda c: coalesce(c, 'NaN')), '|') AS cells FROM trows""")
def k6_table_rows(spark, sf_dir):
    """K6: table rows in sorted files of bounded size."""
    d = scratch_path(spark, "table-rows")
    io.write_tables(B.table_rows(spark, sf_dir, pages=3), d, rows_per_file=5_000)
    return spark.read.parquet(d).select("table_name", "row_no", F.array_join("cells", "|", "NaN").alias("cells"))


@query("k3_report_file", ORACLE["e6_report"])
def k3_report_file(spark, sf_dir):
    """K3: the nested report saved as JSON and read back. A report with a failed metric, which the file names, is no result."""
    vecs = B.embeddings(spark, sf_dir)
    d = scratch_path(spark, "report")
    io.write_report(EV.report(B.pairs(spark, sf_dir), PAIR_KEYS, vecs, vecs.count()), d)
    return _spread_report(spark.read.schema(EV.REPORT).json(d))


def _spread_report(r):
    r = EV.whole(r)
    parts = [(f"rouge.`rouge-{a}`.{x}", f"rouge{a.upper() if a == 'l' else a}_{x}") for a in ("1", "2", "l") for x in "rpf"]
    return r.select(r6("bleu"), *[r6(a, b) for a, b in parts], *[r6(f"bertscore.{x}", x) for x in ("precision", "recall", "f1")], "pairs")


# merged rows of the batch evaluation, in the place of the pairs of the other metrics: keyed by row, as questions repeat
MERGED = """WITH ans0 AS (SELECT u.text AS query, a.text AS answer FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant' WHERE u.text IS NOT NULL AND a.text IS NOT NULL),
ans AS (SELECT 'question ' || CAST(length(query) % 40 AS VARCHAR) AS query, answer FROM ans0),
refs AS (SELECT 'question ' || CAST(length(query) % 40 AS VARCHAR) AS query, min(query) AS reference FROM ans0 GROUP BY 1
         UNION ALL SELECT 'question ' || CAST(length(query) % 40 AS VARCHAR) AS query, max(query) AS reference FROM ans0 GROUP BY 1),
pairs AS (SELECT row_number() OVER () AS conv_id, 0 AS turn, reference, answer FROM ans LEFT JOIN refs USING (query)),
valid"""


def _on_merged(sql: str) -> str:
    """A metric's SQL over the merged rows."""
    return MERGED + sql.split("valid", 1)[1]


@query("e6_evaluate_files", f"""SELECT b.bleu, r.rouge1_r, r.rouge1_p, r.rouge1_f, r.rouge2_r, r.rouge2_p, r.rouge2_f, l."rougeL_r", l."rougeL_p", l."rougeL_f",
       g.precision, g.recall, g.f1, p.pairs
FROM ({_on_merged(ORACLE['e1_corpus_bleu'])}) b, ({_on_merged(ORACLE['e2_rouge_n'])}) r, ({_on_merged(ORACLE['e3_rouge_l_summary'])}) l,
     ({_on_merged(ORACLE['e5_greedy_match'])}) g, ({_on_merged(ORACLE['a12_pair_count'])}) p""")
def e6_evaluate_files(spark, sf_dir):
    """Batch evaluation from files to file: answers and references as CSV, read by their encodings, merged (every question is answered, and referred to,
    several times), checked (P9), evaluated, the report saved as JSON and read back."""
    d = scratch_path(spark, "evaluation")
    p = materialize(_questions_and_answers(spark, sf_dir), "qa").withColumn("q", F.concat(F.lit("question "), (F.length("query") % 40).cast("string")))
    for name, part, encoding in (("latin", p.filter(F.col("answer").rlike(LATIN)), "ISO-8859-1"), ("utf8", p.filter(~F.col("answer").rlike(LATIN)), "UTF-8")):
        io.write_qa_csv(part.select(F.col("q").alias("query"), "answer"), f"{d}/answers-{name}", encoding=encoding)
    refs = p.groupBy("q").agg(F.min("query").alias("least"), F.max("query").alias("most"))
    refs = refs.select(F.col("q").alias("query"), F.explode(F.array("least", "most")).alias("reference"))
    io.write_qa_csv(refs, f"{d}/references")
    answers = io.read_qa_csv(spark, f"{d}/answers-latin", io.ANSWER_SCHEMA).unionByName(io.read_qa_csv(spark, f"{d}/answers-utf8", io.ANSWER_SCHEMA))
    vecs = B.embeddings(spark, sf_dir)
    io.write_report(EV.evaluate_answers(answers, io.read_qa_csv(spark, f"{d}/references"), "query", vecs, vecs.count()), f"{d}/report")
    return _spread_report(spark.read.schema(EV.REPORT).json(f"{d}/report"))


@query("p9_check_input", f"WITH {S.PAIRS} SELECT count(*) AS pairs, 'missing required column(s): reference' AS without_column, 'nothing to evaluate: no row has both an answer and a reference' AS without_rows FROM pairs WHERE answer IS NOT NULL AND reference IS NOT NULL")
def p9_check_input(spark, sf_dir):
    """The input as it is passes; without a column, and without a complete row, the check says what is missing."""
    p = B.pairs(spark, sf_dir)
    said = []
    for broken in (p.drop("reference"), p.withColumn("reference", F.lit(None).cast("string"))):
        try:
            EV.check_input(broken)
            said.append(None)
        except ValueError as e:
            said.append(str(e))
    return EV.drop_missing(EV.check_input(p)).agg(F.count(F.lit(1)).alias("pairs")).withColumn("without_column", F.lit(said[0])).withColumn("without_rows", F.lit(said[1]))


@query("q1_answer_stream", f"""WITH {HYB3}, {CTX1}, a AS ({ANSWERS})
SELECT 'answer' AS kind, query_id, question, answer, CAST(NULL AS VARCHAR) AS line FROM a
UNION ALL SELECT 'broken', NULL, NULL, NULL, 'question ' || CAST(item_id AS VARCHAR) || ': no JSON' FROM benchmark""")
def q1_answer_stream(spark, sf_dir):
    """Q1: questions as JSON lines, among them broken lines and repeated ids, through the stream in two starts (``availableNow``), answered by
    the U3 job batch by batch; answers and broken lines read back."""
    d = scratch_path(spark, "stream")
    q = materialize(B.questions(spark, sf_dir), "questions")
    good = F.to_json(F.struct("query_id", "text"))
    broken = F.concat(F.lit("question "), F.col("query_id").cast("string"), F.lit(": no JSON"))

    def answer(batch):
        p = _contexts_v1(spark, sf_dir, questions=batch)
        return AN.generate_once(p.select("query_id", "question", "prompt"), f"{d}/ledger", keep=["query_id", "question"], flush=64)

    for lines in (q.filter("query_id % 2 = 0").select(F.explode(F.array(good, broken)).alias("value")), q.select(F.explode(F.array(good, broken)).alias("value"))):
        lines.write.mode("append").text(f"{d}/in")
        answer_stream(spark, f"{d}/in", f"{d}/out", answer, f"{d}/checkpoint").awaitTermination()
    a = spark.read.parquet(f"{d}/out/answers").select(F.lit("answer").alias("kind"), "query_id", "question", "answer", F.lit(None).cast("string").alias("line"))
    b = spark.read.parquet(f"{d}/out/broken").select(F.lit("broken").alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"), "line")
    return a.unionByName(b)
