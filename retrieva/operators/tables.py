"""Extracted tables (P6, A15, A16, T12, T13, K6 naming).

Input ``table_rows(doc_id, page_no, row_no, cells ARRAY<STRING>)``; a table is
(doc_id, page_no) and row_no 0 is its header. A table is small (one page), so
rendering collects one table into one row; filters and counts are grouped
aggregates with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import humanise, title_of, word_count

TABLE = ["doc_id", "page_no"]


def usable(cells) -> F.Column:
    """A cell list with at least one non-null, non-blank cell."""
    return F.exists(cells, lambda c: c.isNotNull() & (F.trim(c) != ""))


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    """Drop rows whose cells are all null or blank."""
    return rows.filter(usable(F.col("cells")))


def keep_tables(rows: DataFrame, header_counts: bool = False) -> DataFrame:
    """Keep tables with more than one usable row.

    ``header_counts=True`` is the extraction rule (the header row counts);
    ``False`` is the indexing rule (only data rows count)."""
    u = drop_blank_rows(rows)
    counted = u if header_counts else u.filter(F.col("row_no") != 0)
    keep = counted.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select(*TABLE)
    return u.join(keep, TABLE, "left_semi")


def render_tables(rows: DataFrame) -> DataFrame:
    """Each table as aligned text: every cell right-aligned to its
    column's widest cell, cells joined by one space, rows by newlines in
    row order; a null cell prints as NaN. Output (doc_id, page_no, table_text)."""
    t = rows.groupBy(*TABLE).agg(
        F.sort_array(F.collect_list(F.struct(F.col("row_no").alias("r"), F.col("cells").alias("c")))).alias("__rows"),
        F.max(F.size("cells")).alias("__ncol"))
    cols = F.sequence(F.lit(1), F.col("__ncol"))

    def cell(r, j):
        return F.coalesce(F.try_element_at(r["c"], j), F.lit("NaN"))

    widths = F.transform(cols, lambda j: F.aggregate(F.col("__rows"), F.lit(0),
                                                     lambda acc, r: F.greatest(acc, F.length(cell(r, j)))))
    t = t.withColumn("__w", widths)
    lines = F.transform(F.col("__rows"), lambda r: F.array_join(
        F.transform(cols, lambda j: F.lpad(cell(r, j), F.get(F.col("__w"), j - 1), " ")), " "))
    return t.select(*TABLE, F.array_join(lines, "\n").alias("table_text"))


def table_name(doc_col="doc_id", page_col="page_no") -> F.Column:
    """K6 naming: ``<doc>_table<page>``."""
    return F.concat(F.col(doc_col), F.lit("_table"), F.col(page_col).cast("string"))


def merge_text_and_tables(docs: DataFrame, rendered: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """A15 + T13: text + blank line, then per table in page order
    'Extracted Table:' + table + blank line. Documents without tables keep
    their text plus the blank line (left join). Other columns of ``docs`` stay."""
    per_doc = rendered.groupBy("doc_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("page_no", "table_text"))),
        lambda x: F.concat(F.lit("Extracted Table:\n"), x["table_text"], F.lit("\n\n"))), "").alias("__tables"))
    j = docs.join(per_doc.withColumnRenamed("doc_id", id_col), id_col, "left")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    return j.select(id_col, *others, F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n\n"),
                                              F.coalesce("__tables", F.lit(""))).alias("content"))


def table_documents(rendered: DataFrame) -> DataFrame:
    """Each kept table as its own corpus document: id ``<doc>_table<page>``,
    content = humanised id, blank line, table text."""
    name = table_name()
    content = F.concat(humanise(name), F.lit("\n\n"), F.col("table_text"))
    return rendered.select(name.alias("doc_id"), content.alias("content"), F.lit(None).cast("string").alias("source")) \
                   .select("doc_id", "content", "source", word_count("content").alias("length"),
                           title_of("content").alias("title"))
