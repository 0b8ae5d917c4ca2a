"""Corpus preparation.

A document is one row; pages, tokens and table rows are long tables keyed by
document id and joined back by key. Grouping by document keeps every group
bounded by one document's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..functions.text import clean_tokens, is_not_blank, prefixed_content, remove_stop_words, title_of, word_count
from ..session import materialize, spread

# Noun suffix rules (suffix, replacement) in rule order.
NOUN_SUFFIX_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
                     ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))

JOINERS = ("concat", "line_after", "between_nonempty")


def page_lists(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """A13, first half: (doc, __texts), each document's page texts in page order."""
    agg = pages.groupBy(doc_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t")))).alias("__pg"))
    return agg.select(doc_col, F.transform("__pg", lambda x: F.coalesce(x["t"], F.lit(""))).alias("__texts"))


def joined(joiner: str) -> F.Column:
    """A13, second half: the page texts of ``page_lists`` as one text.

    ``concat``: pages glued; ``line_after``: a newline after every page (OCR);
    ``between_nonempty``: newline between pages that have text."""
    if joiner == "concat":
        return F.array_join("__texts", "")
    if joiner == "line_after":
        return F.array_join(F.transform("__texts", lambda t: F.concat(t, F.lit("\n"))), "")
    if joiner == "between_nonempty":
        return F.array_join(F.filter("__texts", lambda t: t != ""), "\n")
    raise ValueError(f"joiner must be one of {JOINERS}")


def join_pages(pages: DataFrame, joiner: str = "concat", doc_col: str = "doc_id",
               page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """Page texts -> one document text in page order."""
    return page_lists(pages, doc_col, page_col, text_col).select(doc_col, joined(joiner).alias(text_col))


def mean_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Average words per document (null when there are no documents)."""
    return docs.agg(F.avg(word_count(text_col)).alias("avg_words"), F.count(F.lit(1)).alias("documents"))


def dedupe_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: key = md5(text), smallest id represents it.

    Grouping on the 32-byte hash keeps texts out of the shuffle; map-side
    partial aggregation folds a heavily copied text before it moves."""
    return (docs.groupBy(F.md5(F.col(text_col)).alias("content_key"))
                .agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")))


# Nouns whose plural no suffix rule finds (form, lemma).
IRREGULAR_NOUNS = (("children", "child"), ("corpora", "corpus"), ("criteria", "criterion"), ("feet", "foot"), ("geese", "goose"), ("indices", "index"),
                   ("lice", "louse"), ("matrices", "matrix"), ("mice", "mouse"), ("oxen", "ox"), ("people", "person"), ("phenomena", "phenomenon"),
                   ("teeth", "tooth"), ("vertices", "vertex"))
MAX_SENT_FORMS = 200_000  # rows of a lexicon that is broadcast, counted first; a larger one is joined by shuffle


def irregular_nouns(spark) -> DataFrame:
    """A small lexicon (form, lemma) to start from."""
    return spark.createDataFrame(list(IRREGULAR_NOUNS), "form string, lemma string")


def lemma_map(tokens: DataFrame, tok_col: str = "tok", lexicon: DataFrame | None = None) -> DataFrame:
    """Token -> lemma, for tokens that a noun rule rewrites to a corpus token (the corpus lexicon).

    Of several such rewrites the shortest wins, then the first in rule order ("women" -> "woman": as long, still its lemma).

    ``lexicon`` (form, lemma) holds irregular forms and goes before the rules: a token that is a form there gets its lemma (of several the shortest,
    then the first in code-point order), whether or not the corpus holds that lemma; a form that is its own lemma is kept from the rules. Rows with a null
    in either column say nothing. The distinct tokens are written first, so the texts are read and cut into tokens once."""
    return _lemmas(materialize(tokens.select(F.col(tok_col).alias("tok")).distinct(), "distinct-tokens"), lexicon)


def _lemmas(lex: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """``lemma_map`` of distinct tokens (tok)."""
    if lexicon is not None:
        known = lexicon.filter("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min(F.struct(F.length("lemma").alias("l"), "lemma")).alias("b"))
        known = materialize(known.select(F.col("form").alias("tok"), F.col("b.lemma").alias("lemma")), "lexicon")
        if known.limit(MAX_SENT_FORMS + 1).count() <= MAX_SENT_FORMS:
            known = F.broadcast(known)
        by_rule = _lemmas(lex, None).join(known.select("tok"), "tok", "left_anti")
        return lex.join(known, "tok").filter("tok <> lemma").select("tok", "lemma").unionByName(by_rule)
    cands = [F.when(F.col("tok").endswith(suf), F.struct(
        F.lit(i).alias("o"), F.concat(F.expr(f"substring(tok, 1, length(tok) - {len(suf)})"), F.lit(rep)).alias("c")))
        for i, (suf, rep) in enumerate(NOUN_SUFFIX_RULES, start=1)]
    ex = (lex.select("tok", F.explode(F.filter(F.array(*cands), lambda x: x.isNotNull())).alias("x"))
             .select("tok", F.col("x.o").alias("o"), F.col("x.c").alias("c")))
    valid = ex.join(lex.select(F.col("tok").alias("c")), "c", "left_semi")
    return (valid.groupBy("tok").agg(F.min(F.struct(F.length("c").alias("l"), F.col("o"), F.col("c"))).alias("b"))
                 .select("tok", F.col("b.c").alias("lemma")))


def content_tokens(docs: DataFrame, id_col: str, text_col: str, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(id, __toks): the tokens of T1 without stop words, one row per document."""
    t = spread(docs.select(id_col, text_col)).select(id_col, clean_tokens(text_col).alias("__all"))
    if not stop_words:
        return t.withColumnRenamed("__all", "__toks")
    return remove_stop_words(t, "__all", "__toks", stop_words).drop("__all")


def clean_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               stop_words=ENGLISH_STOP_WORDS, lemmatize: bool = True, lexicon: DataFrame | None = None) -> DataFrame:
    """Tokens (T1 rule) -> drop stop words (J8) -> lemmas (T3) -> joined by spaces.

    Output (id, cleaned); a document without tokens gets ''. Occurrences stay in their document's row: only
    distinct tokens of each document meet the lemmas, and the few that have one come back as a map. Rows that share an id (or have none) keep
    their own texts; a lemma depends on the token alone, so they share a map. ``lexicon``: see ``lemma_map``. Tokens with inner punctuation ("cat's") are dropped whole."""
    toks = content_tokens(docs, id_col, text_col, stop_words)
    if not lemmatize:
        return toks.select(id_col, F.array_join("__toks", " ").alias("cleaned"))
    toks = materialize(toks, "clean-tokens")
    each = toks.select(id_col, F.explode(F.array_distinct("__toks")).alias("tok"))
    found = each.join(lemma_map(each, lexicon=lexicon), "tok").groupBy(F.col(id_col).alias("__id")).agg(
        F.map_from_entries(F.collect_set(F.struct("tok", "lemma"))).alias("__m"))
    j = toks.join(found, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return j.select(id_col, F.array_join(F.transform("__toks", lambda t: F.coalesce(F.col("__m")[t], t)), " ").alias("cleaned"))


def with_fallback(primary: DataFrame, fallback: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """P10: use the fallback text where the primary text is blank.

    Output (id, text, text_origin in {'primary', 'fallback'})."""
    f = fallback.select(id_col, F.col(text_col).alias("__fb"))
    j = primary.join(f, id_col, "left")
    blank = ~is_not_blank(F.coalesce(F.col(text_col), F.lit("")))
    return j.select(id_col,
                    F.when(blank, F.coalesce("__fb", F.lit(""))).otherwise(F.col(text_col)).alias(text_col),
                    F.when(blank, F.lit("fallback")).otherwise(F.lit("primary")).alias("text_origin"))


def corpus_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str | None = None,
                skip_blank: bool = True) -> DataFrame:
    """S1 + P2-P5: (doc_id, content, source, length, title) with the humanised
    id prefixed; blank texts skipped."""
    d = docs.filter(is_not_blank(text_col)) if skip_blank else docs
    content = prefixed_content(id_col, text_col)
    src = F.col(source_col) if source_col else F.lit(None).cast("string")
    return d.select(F.col(id_col).alias("doc_id"), content.alias("content"), src.alias("source")) \
            .select("doc_id", "content", "source", word_count("content").alias("length"),
                    title_of("content").alias("title"))


def union_corpus(text_docs: DataFrame, table_docs: DataFrame) -> DataFrame:
    """O1: bag union of text documents and table documents (no de-duplication)."""
    return text_docs.unionByName(table_docs)


def plain_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text as it is, no prefix and no blank filter."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"))
