"""Toxicity by non-negative positive-unlabelled learning.

A linear model on the presence of words is trained from documents confirmed toxic and from unlabelled documents. With
class prior ``p`` and the logistic loss, the risk is

    p * R_positive(+)  +  max(0, R_unlabelled(-) - p * R_positive(-)):

the second part estimates the loss on clean documents from unlabelled ones. As it can't be negative, a step that made it so
goes the other way instead (which is what keeps the model from overfitting the positives).

Training rows are bounded samples by hash of the id: about MAX_POSITIVE confirmed and MAX_UNLABELLED unlabelled documents, from
the rows outside the held-out fold only. Words are counted over the sample in Spark; the MAX_WORDS common ones whose share differs most
between positives and unlabelled are the features. Every whole document is scored.

Cases: null and empty texts have no words and get the score of the intercept; a null id can't be labelled, belongs to the held-out fold
and is scored; repeated label rows count as toxic if one does; repeated rows each return a row; without positives the score is the prior
everywhere; an empty table returns no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieva.session import ship_package

from .common import small_batches

MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 5_000, 20_000, 200
#: A feature is in this share of the positives or of the unlabelled sample at least, so that rare words, of copies above all, aren't learnt by heart.
SUPPORT = 0.005
FOLDS = 5
EPOCHS, RATE, L2 = 300, 0.1, 1e-5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def held_out(id_col: str = "doc_id") -> Column:
    """Fold 0 of crc32(id as text) mod 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _sampled(id_col: str, n: int, most: int) -> Column:
    """About ``most`` of ``n`` rows, by hash of the id (in steps of 2**-52, so that the share isn't 0 in any table)."""
    return F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 52)) < max(1, int((1 << 52) * min(1.0, most / max(n, 1))))


def class_prior(labels: DataFrame) -> float:
    """Share of toxic documents among the rows to learn from."""
    n, t = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    return min(0.9, max(0.01, t / n)) if n else 0.1


def samples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(positive, text): the bounded training rows. labels(doc_id, toxic) are those to learn from."""
    toxic = labels.filter("toxic = 1").select("doc_id")
    chosen = toxic.filter(_sampled("doc_id", toxic.count(), MAX_POSITIVE))
    open_docs = docs.filter(~held_out())
    unlabelled = open_docs.filter(_sampled("doc_id", open_docs.select("doc_id").count(), MAX_UNLABELLED))
    positive = open_docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # the ids of a bounded sample
    return positive.select(F.lit(True).alias("positive"), "text").unionByName(unlabelled.select(F.lit(False).alias("positive"), "text"))


def vocabulary(rows: DataFrame) -> list[str]:
    """The words whose share of documents differs most (two-proportion z) between positives and unlabelled."""
    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sums = {True: Counter(), False: Counter()}
            for positive, text in zip(pdf["positive"], pdf["text"], strict=True):
                sums[bool(positive)].update(words_of(text or ""))
                sums[bool(positive)][""] += 1  # documents
            found = list(sums[True].keys() | sums[False].keys())
            yield pd.DataFrame({"word": found, "p": [sums[True][w] for w in found], "u": [sums[False][w] for w in found]})

    counts = rows.mapInPandas(count, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n = counts.filter("word = ''").first()
    if n is None or not n["p"] or not n["u"]:
        return []
    np_, nu = float(n["p"]), float(n["u"])
    share = (F.col("p") + F.col("u")) / (np_ + nu)
    z = (F.col("p") / np_ - F.col("u") / nu) / F.sqrt(share * (1 - share) * (1 / np_ + 1 / nu) + 1e-12)
    common = F.greatest(F.col("p") / np_, F.col("u") / nu) >= SUPPORT
    top = counts.filter((F.col("word") != "") & (F.col("p") + F.col("u") >= 3) & common).orderBy(F.abs(z).desc(), "word").limit(MAX_WORDS)
    return [r["word"] for r in top.collect()]


def fit(x: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the non-negative PU risk with logistic loss (Adam on all rows)."""
    xp, xu = x[positive], x[~positive]
    w, start = np.zeros(x.shape[1] + 1), np.log(prior / (1 - prior))
    w[-1] = start
    if not len(xp) or not len(xu):
        return w[:-1], float(start)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        fp, fu = xp @ w[:-1].astype(np.float32) + w[-1], xu @ w[:-1].astype(np.float32) + w[-1]
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # gradients by score of: prior * R_p(+), and R_u(-) - prior * R_p(-)
        sign = 1.0 if clean >= 0 else -1.0
        gp = (prior * (sp - 1) if clean >= 0 else np.zeros_like(sp)) - sign * prior * sp
        gp, gu = gp / len(xp), sign * su / len(xu)
        g = np.append(xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + L2 * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """(weight of each word, intercept) from docs(doc_id, text) and labels(doc_id, toxic); held-out rows are left out of both."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    known = labels.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior, rows = class_prior(known), samples(docs, known)
    chosen = vocabulary(rows)
    at = {w: i for i, w in enumerate(chosen)}

    def features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"positive": pdf["positive"], "words": [[at[w] for w in words_of(t or "") if w in at] for t in pdf["text"]]})

    if not chosen:
        return {}, float(np.log(prior / (1 - prior)))
    found = rows.mapInPandas(features, "positive boolean, words array<int>").toPandas()  # the bounded sample, as word numbers
    x = np.zeros((len(found), len(chosen)), np.float32)
    for i, on in enumerate(found["words"]):
        x[i, np.asarray(on, dtype=np.int64)] = 1
    weights, intercept = fit(x, found["positive"].to_numpy(bool), prior)
    return dict(zip(chosen, weights.tolist(), strict=True)), intercept


def score(text: Column, model: tuple[dict[str, float], float]) -> Column:
    """Probability that a text is toxic."""
    weights, intercept = model
    words = frozenset(weights)

    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        f = np.array([intercept + sum(weights[w] for w in sorted(words & words_of(t))) for t in texts])
        return pd.Series(1 / (1 + np.exp(-f)), dtype="float64")

    return of(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with held_out, score and predicted added."""
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    out = docs.withColumn("held_out", held_out()).withColumn("score", score(F.col("text"), model))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
