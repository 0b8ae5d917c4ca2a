"""Column expressions for text: tokenisers, n-grams, names, titles, prompts.

All are built-in Spark SQL expressions (JVM side); none is a Python UDF.
Character classes are spelled ``[\\p{L}\\p{N}_]`` rather than ``\\w`` so that
the same pattern means the same thing in Spark (Java regex) and DuckDB (RE2).
"""

from __future__ import annotations

from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stopwords import ENGLISH_STOP_WORDS

# White space as in Python's str.split(): Unicode separators and the ASCII controls; the same text works in Java and RE2.
SPACE = r"\p{Z}\x09-\x0d\x1c-\x1f\x{85}"

#: The characters of SPACE.
SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P1..P5: names, prefixes, titles, word counts -------------------------

def path_stem(path) -> Column:
    """File name without directory and without its last suffix."""
    base = F.regexp_extract(col(path), r"([^/]*)$", 1)
    # leading dots belong to the name ('.bashrc' has no suffix)
    stem = F.regexp_extract(base, r"^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(stem == "", base).otherwise(stem)


def humanise(name) -> Column:
    """P2 helper: '_' and '-' become spaces."""
    return F.translate(col(name), "_-", "  ")


def strip_ws(text) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` strips spaces only): looks at the ends of the text, not at all of it."""
    return F.btrim(col(text), F.lit(SPACE_CHARS))


def prefixed_content(name, text) -> Column:
    """Humanised name, a blank line, then the stripped text."""
    return F.concat(humanise(name), F.lit("\n\n"), strip_ws(text))


def title_of(content) -> Column:
    """First line of the content, or 'Untitled' when the content is empty."""
    c = col(content)
    return F.when(c.isNull() | (c == ""), F.lit("Untitled")).otherwise(F.substring_index(c, "\n", 1))


def word_count(text) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(col(text), f"[{SPACE}]+"), lambda x: x != ""))


def is_not_blank(text) -> Column:
    """P5: true when the text holds a non-whitespace character."""
    return col(text).rlike(f"[^{SPACE}]")


# --- T4..T8: tokenisers ----------------------------------------------------

def retrieval_tokens(text) -> Column:
    """T4: lower-cased word tokens of two or more word characters.

    Splitting on runs of non-word characters and keeping pieces of length >= 2
    yields exactly the maximal word runs of length >= 2, about twice as fast
    as extracting regex matches."""
    pieces = F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(pieces, lambda x: F.length(x) >= 2)


def eval_tokens(text) -> Column:
    """Evaluation tokens: sentences split on .!? then words on whitespace, flattened."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), f"[.!?{SPACE}]+"), lambda x: x != "")


def whitespace_tokens(text) -> Column:
    """Case-sensitive whitespace tokens."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), f"[{SPACE}]+"), lambda x: x != "")


def rouge_sentences(text) -> Column:
    """ROUGE sentences: pieces between '.' that are not empty, with inner
    whitespace collapsed to single spaces (a piece of only spaces becomes '')."""
    pieces = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\."), lambda s: F.length(s) > 0)
    return F.transform(pieces, lambda s: F.array_join(F.filter(F.split(s, f"[{SPACE}]+"), lambda w: w != ""), " "))


def rouge_words(text) -> Column:
    """ROUGE words: each sentence split on single spaces, flattened. As in
    the scoring package, a whitespace-only sentence contributes one '' word."""
    return F.flatten(F.transform(rouge_sentences(text), lambda s: F.split(s, " ")))


def clean_tokens(text) -> Column:
    """T1 (first half): whitespace tokens, lower-cased, edge punctuation trimmed,
    kept only when purely letters/digits (tokens with inner punctuation drop)."""
    trimmed = F.transform(
        F.split(F.coalesce(col(text), F.lit("")), f"[{SPACE}]+"),
        lambda x: F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(trimmed, lambda x: x.rlike(r"^[\p{L}\p{N}]+$"))


def remove_stop_words(df: DataFrame, in_col: str, out_col: str,
                      stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Drop stop words from an array column with Spark's hash-set remover."""
    return StopWordsRemover(inputCol=in_col, outputCol=out_col,
                            stopWords=list(stop_words), caseSensitive=True).transform(df)


def add_ngrams(df: DataFrame, tokens: str, out_col: str, n_min: int = 1, n_max: int = 3) -> DataFrame:
    """T5 with Spark's NGram transformer (compiled) for n >= 2."""
    cols = []
    tmp = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            cols.append(F.col(tokens))
            continue
        name = f"__ngram{n}"
        df = NGram(n=n, inputCol=tokens, outputCol=name).transform(df)
        cols.append(F.col(name))
        tmp.append(name)
    return df.withColumn(out_col, F.concat(*cols) if len(cols) > 1 else cols[0]).drop(*tmp)


# --- T14/T15: prompts and chat requests --------------------------------------

# Prompt wordings, system message and request limits, as text.
PROMPT_V1 = ("Use the following context to answer the question concisely and clearly.\n\n"
             "Context:\n{context}\n\nQuestion:\n{question}\n")
PROMPT_V2 = ("Use the following context to answer the question as concisely and clearly as possible.\n\n"
             "Context:\n{context}\n\nQuestion:\n{question}\n")
SYSTEM_MESSAGE = "You are a helpful assistant for academic research."


def prompt(context, question, template: str = PROMPT_V1) -> Column:
    """Fill a prompt template from two columns."""
    head, rest = template.split("{context}")
    mid, tail = rest.split("{question}")
    return F.concat(F.lit(head), F.coalesce(col(context), F.lit("")), F.lit(mid), col(question), F.lit(tail))


def chat_request(prompt_col, model: str = "mistralai/Mistral-7B-Instruct-v0.1",
                 temperature: float = 0.7, max_tokens: int = 512,
                 system: str = SYSTEM_MESSAGE) -> Column:
    """The chat-completion request body as JSON text."""
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), col(prompt_col).alias("content")))
    return F.to_json(F.struct(F.lit(model).alias("model"), msgs.alias("messages"),
                              F.lit(temperature).alias("temperature"),
                              F.lit(max_tokens).alias("max_tokens")))
