"""File sources and sinks.

Scans use Spark's own file sources (text, csv, binaryFile, parquet) with explicit
schemas. Where each file has its own width or encoding, whole files are read as
rows and parsed in their tasks. Spark's sources hold the list of files on the driver; for very
many files there is ``in_tasks=True``: the tasks list the folders and read the files (``list_files``).
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_stem
from ..operators.corpus import corpus_rows
from ..operators.sparse import Bm25Index, TermRanges, TfidfIndex, block_bounds, in_parts, term_ranges
from ..operators.tables import table_name
from ..session import materialize, shared_fs, ship_package

# Strings pandas reads as missing by default.
PANDAS_NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

QA_SCHEMA = T.StructType([T.StructField("query", T.StringType()), T.StructField("reference", T.StringType())])
ANSWER_SCHEMA = T.StructType([T.StructField("query", T.StringType()), T.StructField("answer", T.StringType())])


#: Folders that very many files are dealt to, by their names.
FOLDERS = 256

#: Files, and bytes, that a task reads before it passes them on.
READ_FILES, READ_BYTES = 1_000, 1 << 24

#: Files, and bytes, that one task reads.
TASK_FILES, TASK_BYTES = 20_000, 1 << 28


# --- many files -----------------------------------------------------------------------

def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files under ``path``, at any depth, whose names fit ``glob``; as in Spark's sources, names that begin with
    ``_`` or ``.`` are no files. Every folder is listed by a task, one level after the other; the driver sees the folders only."""
    ship_package(spark)
    top = path.rstrip("/")

    def entries(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs
        fs, root = shared_fs(top)
        for pdf in it:
            for folder in pdf["folder"]:
                found = fs.get_file_info(arrow_fs.FileSelector(root + folder))
                found = [x for x in found if x.base_name[:1] not in ("_", ".")]
                found = [x for x in found if x.type == arrow_fs.FileType.Directory or fnmatchcase(x.base_name, glob)]
                for at in range(0, len(found), 10_000):
                    yield pd.DataFrame([(top + f"{folder}/{x.base_name}", x.type == arrow_fs.FileType.Directory, x.size, x.mtime) for x in found[at:at + 10_000]],
                                       columns=["path", "folder", "length", "modificationTime"])

    folders, levels = [""], []
    while folders:
        n = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
        rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(n)
        level = materialize(rows.mapInPandas(entries, "path string, folder boolean, length long, modificationTime timestamp"), "files")
        levels.append(level.filter("NOT folder").drop("folder"))
        folders = [r[0][len(top):] for r in level.filter("folder").select("path").collect()]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _read_in_tasks(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of the files of ``list_files``; a task holds READ_FILES files or READ_BYTES, or one larger file, at a time."""
    top = path.rstrip("/")
    files = list_files(spark, path, glob).select("path", "length")
    count, size = files.agg(F.count(F.lit(1)), F.sum("length")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_FILES), -(-(size or 0) // TASK_BYTES))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = shared_fs(top)
        for pdf in it:
            rows, held = [], 0
            for p in pdf["path"]:
                with fs.open_input_stream(root + p[len(top):]) as f:
                    rows.append((p, f.read()))
                held += len(rows[-1][1])
                if len(rows) >= READ_FILES or held >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "content"])

    return files.select("path").repartition(n, "path").mapInPandas(read, "path string, content binary")


# --- S1, S6: text files ---------------------------------------------------------------

def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt", in_tasks: bool = False) -> DataFrame:
    """One row per file: (path, doc_id = file stem, text)."""
    if in_tasks:
        df = _read_in_tasks(spark, path, glob).select("path", F.col("content").cast("string").alias("text"))
    else:
        df = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("doc_id", path_stem("path"))


def scan_text_corpus(spark: SparkSession, path: str, in_tasks: bool = False) -> DataFrame:
    """Text files -> corpus rows (blank files skipped, humanised name prefixed)."""
    return corpus_rows(read_text_files(spark, path, in_tasks=in_tasks), "doc_id", "text", source_col="path")


def scan_plain_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Text files as they are (no prefix, no blank filter)."""
    return read_text_files(spark, path).select("doc_id", F.col("text").alias("content"), F.col("path").alias("source"))


# --- S2: table CSV files ------------------------------------------------------------------

def _whole_files(spark: SparkSession, path: str, glob: str, in_tasks: bool = False) -> DataFrame:
    """(path, text, encoding): each file decoded as UTF-8 when its bytes are valid, else as ISO-8859-1 (S3)."""
    b = _read_in_tasks(spark, path, glob) if in_tasks else spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    return b.select("path", F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"),
                    F.when(utf8, "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def _csv_rows(text: str) -> list[list[str]]:
    """Records of a CSV text: quoted cells may hold line breaks and doubled quotes; blank lines are no records."""
    text = text.removeprefix("\ufeff")
    return [r for r in csv.reader(StringIO(text, newline=""), strict=True) if r]


def _parsed(files: DataFrame) -> DataFrame:
    """(path, row_no, cells, error): every record of every file, by the file's own width; a broken file is one row with its error."""
    ship_package(files.sparkSession)

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for pdf in it:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    rows += [(path, i, r, None) for i, r in enumerate(_csv_rows(text))]
                except csv.Error as e:
                    rows.append((path, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "row_no", "cells", "error"])

    return files.select("path", "text").mapInPandas(parse, "path string, row_no long, cells array<string>, error string")


def read_table_csvs(spark: SparkSession, path: str, glob: str = "*_table*.csv", in_tasks: bool = False) -> DataFrame:
    """S2 part 1: table CSV files -> table_rows(doc_id, page_no, row_no, cells).

    doc_id/page_no come from the ``<doc>_table<page>`` file name; rows keep file
    order (row 0 = header). A file's widest row gives its width: shorter rows are filled with nulls, an empty
    cell is null. A broken file is left out here and listed by ``broken_table_csvs``."""
    rows = _parsed(_whole_files(spark, path, glob, in_tasks)).filter("error IS NULL")
    width = Window.partitionBy("path")  # one file
    rows = rows.withColumn("__n", F.max(F.size("cells")).over(width)).withColumn("__stem", path_stem("path"))
    cells = F.transform("cells", lambda c: F.nullif(c, F.lit("")))
    filled = F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.col("__n") - F.size("cells")))
    return rows.select(F.regexp_extract("__stem", r"^(.*)_table\d+$", 1).alias("doc_id"),
                       F.regexp_extract("__stem", r"_table(\d+)$", 1).cast("int").alias("page_no"),
                       "row_no", filled.alias("cells"))


def broken_table_csvs(spark: SparkSession, path: str, glob: str = "*_table*.csv") -> DataFrame:
    """(path, error) of the files that could not be parsed."""
    return _parsed(_whole_files(spark, path, glob)).filter("error IS NOT NULL").select("path", "error")


# --- S3, S4: CSV question / answer tables ---------------------------------------------------

def file_encodings(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """S3: per file, 'UTF-8' when its bytes are valid UTF-8, else 'ISO-8859-1'."""
    return _whole_files(spark, path, glob).select("path", "encoding")


def read_qa_csv(spark: SparkSession, path: str, schema: T.StructType = QA_SCHEMA,
                na_values=PANDAS_NA_VALUES, encoding: str | None = None) -> DataFrame:
    """S4 (+S3): header CSV with quoted multi-line cells, doubled quotes, edge
    spaces kept; the pandas missing-value strings become null.

    With ``encoding`` Spark's CSV reader reads the files. Without it, every file is decoded by its own
    encoding (S3) inside one plan and its columns are taken by the names in its header."""
    if encoding:
        df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
                   .option("quote", '"').option("escape", '"').option("encoding", encoding)
                   .option("nullValue", None).option("emptyValue", "").csv(path))
    else:
        files = _whole_files(spark, path, "*").filter(~path_stem("path").rlike("^[._]"))
        rows = _parsed(files)
        failed = F.raise_error(F.concat(F.lit("broken CSV file "), F.col("path"), F.lit(": "), F.col("error")))
        rows = rows.withColumn("cells", F.when(F.col("error").isNotNull(), failed.cast("array<string>")).otherwise(F.col("cells")))
        header = F.first(F.when(F.col("row_no") == 0, F.col("cells")), ignorenulls=True).over(Window.partitionBy("path"))  # one file
        rows = rows.withColumn("__h", header).filter("row_no > 0")
        df = rows.select(*[F.get("cells", F.array_position("__h", f.name).cast("int") - 1).cast(f.dataType).alias(f.name) for f in schema.fields])
    na = list(na_values)
    return df.select(*[F.when(F.col(f.name).isin(na), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
                       for f in schema.fields])


# --- S5: raw document listing -------------------------------------------------------------

def list_raw_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, doc_id, kind, length, modificationTime); kind by suffix,
    case-sensitive: '.pdf' -> 'pdf', '.jpg/.jpeg/.png' -> 'image'; others skipped.
    File contents are not read (column pruning)."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    kind = (F.when(F.col("path").endswith(".pdf"), "pdf")
             .when(F.col("path").endswith(".jpg") | F.col("path").endswith(".jpeg") | F.col("path").endswith(".png"),
                   "image"))
    return (b.select("path", "length", "modificationTime").withColumn("kind", kind)
             .filter(F.col("kind").isNotNull()).withColumn("doc_id", path_stem("path")))


# --- S8 / K4: saved indexes ------------------------------------------------------------------

#: Vectors in one file of a cell, at most.
CELL_ROWS = 1 << 18


@dataclass
class CellIndex:
    """Vectors with their cells: vectors(doc_id, dvec, cell_id), centroids(cell_id, centroid, and the bounds of ``dense.cell_bounds`` if it has them)."""
    vectors: DataFrame
    centroids: DataFrame


def _by_cell(vectors: DataFrame, rows_per_file: int) -> DataFrame:
    """Vectors dealt to tasks by cell and size: a cell of more than ``rows_per_file`` vectors is written by several tasks."""
    v = materialize(vectors, "cell-vectors")  # the sizes come from the rows that are written
    sizes = v.groupBy("cell_id").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("__files"))
    at = F.sum("__files").over(Window.orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1))  # one row for each cell
    sizes = materialize(sizes.withColumn("__at", F.coalesce(at, F.lit(0)).cast("int")), "cell-files")
    n = sizes.agg(F.sum("__files")).first()[0] or 1
    placed = v.join(sizes, "cell_id").withColumn("__task", F.col("__at") + F.pmod(F.xxhash64("doc_id"), F.col("__files")).cast("int"))
    return placed.repartitionById(n, F.col("__task")).drop("__files", "__at", "__task")


def _save(spark: SparkSession, base: str, kind: str, parts: dict[str, DataFrame], written: tuple[str, ...] = (), **settings) -> None:
    for name, df in parts.items():
        folders = {"postings": "part", "blocks": "part", "vectors": "cell_id"}.get(name)
        w = df.write.mode("overwrite")
        (w.partitionBy(folders) if folders else w).parquet(f"{base}/{name}")
    # the manifest comes last: an index without one isn't complete
    row = [(kind, json.dumps(settings), sorted([*parts, *written]))]
    spark.createDataFrame(row, "kind string, settings string, parts array<string>").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest")


def _save_ranges(spark: SparkSession, base: str, ranges: TermRanges) -> None:
    spark.createDataFrame(list(zip(ranges.first, ranges.parts, strict=True)), "first string, parts int").coalesce(1).write.mode("overwrite").parquet(f"{base}/ranges")


def _load_ranges(spark: SparkSession, base: str) -> TermRanges:
    rows = sorted(spark.read.parquet(f"{base}/ranges").collect(), key=lambda r: r["first"])  # one row for each term range
    return TermRanges([r["first"] for r in rows], [r["parts"] for r in rows])


def save_index(base: str, index: TfidfIndex | Bm25Index | CellIndex, rows_per_part: int | None = None) -> None:
    """K4: an index as Parquet under ``base``, with a manifest of its settings.

    Postings are in folders by term range, each of at most ``rows_per_part`` postings (``sparse.PART_ROWS``, fewer for a small index) and written once
    by a task of its own; a term with more has several. Vectors are in folders by cell, large cells in several files. The
    ranges are part of the index, so a search opens only those of its terms, or the cells it probes."""
    if isinstance(index, CellIndex):
        _save(index.vectors.sparkSession, base, "cells", {"vectors": _by_cell(index.vectors, rows_per_part or CELL_ROWS), "centroids": index.centroids})
        return
    tfidf = isinstance(index, TfidfIndex)
    stats = index.vocab if tfidf else index.idf
    spark, ranges = stats.sparkSession, term_ranges(stats, rows_per_part)
    _save_ranges(spark, base, ranges)
    postings = in_parts(index.postings.drop("part"), ranges, stats.select("term"))
    if tfidf:
        _save(spark, base, "tfidf", {"vocab": index.vocab, "postings": postings}, n_docs=index.n_docs, max_features=index.max_features,
              stop_words=list(index.stop_words), ngram_range=list(index.ngram_range))
    else:
        settings = dict(n_docs=index.n_docs, avgdl=index.avgdl, k1=index.k1, b=index.b, lengths=index.lengths)
        _save(spark, base, "bm25", {"idf": index.idf, "postings": postings}, **settings)
        # the blocks' bounds are taken from the written postings
        blocks = block_bounds(load_index(spark, base))
        _save(spark, base, "bm25", {"blocks": blocks}, written=("idf", "postings"), **settings)


def load_index(spark: SparkSession, base: str) -> TfidfIndex | Bm25Index | CellIndex:
    """The saved index as the object that the searches take. A missing or unfinished index is an error."""
    m = spark.read.parquet(f"{base}/manifest").first()
    s = json.loads(m["settings"])
    read = lambda p: spark.read.parquet(f"{base}/{p}")
    if m["kind"] == "cells":
        return CellIndex(read("vectors"), read("centroids"))
    ranges = _load_ranges(spark, base)
    if m["kind"] == "tfidf":
        return TfidfIndex(read("vocab"), read("postings"), s["n_docs"], s["max_features"], tuple(s["stop_words"]), tuple(s["ngram_range"]), ranges)
    blocks = read("blocks") if "blocks" in m["parts"] else None
    lengths = {int(c): n for c, n in s["lengths"].items()}
    return Bm25Index(read("postings"), read("idf"), s["n_docs"], s["avgdl"], s["k1"], s["b"], lengths, ranges, blocks)


# --- K1, K2, K3, K5, K6: sinks --------------------------------------------------------------

def _csv_writer(w):
    """Header, doubled quotes, edge spaces and empty texts kept."""
    return (w.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: append (query, answer) rows; a CSV part carries its own header, and texts are kept as they are."""
    w = df.write.mode("append")
    if fmt == "csv":
        _csv_writer(w).csv(path)
    else:
        w.parquet(path)


def write_qa_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """K2: CSV with header; leading/trailing spaces kept, quotes doubled."""
    _csv_writer(df.write.mode("overwrite")).option("encoding", encoding).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """K3: the nested evaluation record (one row) as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_cleaned(df: DataFrame, path: str) -> None:
    """K5: cleaned text per document."""
    df.select("doc_id", "content").write.mode("overwrite").parquet(path)


def write_tables(rows: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """K6: extracted table rows, sorted by document, page and row, in files of about ``rows_per_file`` rows; the file-style name
    ``<doc>_table<page>`` is kept as a column. A document with many rows is spread over several files."""
    named = materialize(rows.withColumn("table_name", table_name()), "table-rows")
    n = max(1, -(-named.count() // rows_per_file))
    order = ["doc_id", "page_no", "row_no"]
    named.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_files(files: DataFrame, path: str, folders: int = 0) -> DataFrame:
    """Rows (name, content) as files under ``path``, written by the tasks through Arrow's file systems (so shared storage of any kind); a task
    that is run again writes its files anew. With ``folders``, they are dealt to so many folders by name. Returns (name, length)."""
    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = shared_fs(path)
        made = set()
        for pdf in it:
            for name, content, folder in zip(pdf["name"], pdf["content"], pdf["folder"], strict=True):
                at = root if folder < 0 else f"{root}/{folder:05d}"
                if at not in made:
                    fs.create_dir(at, recursive=True)
                    made.add(at)
                with fs.open_output_stream(f"{at}/{name}") as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"name": pdf["name"], "length": [len(c) for c in pdf["content"]]})
        if not made:
            fs.create_dir(root, recursive=True)

    ship_package(files.sparkSession)
    folder = F.pmod(F.xxhash64("name"), F.lit(folders)).cast("int") if folders else F.lit(-1)
    return materialize(files.select("name", F.col("content").cast("binary").alias("content"), folder.alias("folder")).mapInPandas(put, "name string, length long"), "written-files")


def write_table_csvs(rows: DataFrame, path: str, folders: int = 0) -> DataFrame:
    """K6 as files: one CSV file ``<doc>_table<page>.csv`` for each table of table_rows(doc_id, page_no, row_no, cells), rows in order, an absent cell empty.
    A group is one table. Returns (name, length)."""
    quoted = F.transform("cells", lambda c: F.when(c.rlike('[",\r\n]') | (c == ""), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))))
    lines = rows.select("doc_id", "page_no", F.struct("row_no", F.array_join(quoted, ",").alias("line")).alias("r"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: F.concat(r["line"], F.lit("\n"))), "")
    files = lines.groupBy("doc_id", "page_no").agg(text.alias("content"))
    return write_files(files.select(F.concat(table_name(), F.lit(".csv")).alias("name"), "content"), path, folders)
