"""Language identification by Bayesian evidence fusion.

For each language L the posterior is proportional to

    P(text | L) * P(declared | L) * P(markup | L) * P(address suffix | L) * P(L | host).

* Languages: those that MIN_DOCUMENTS documents and a share of MIN_SHARE of the declared ones declare at least, so 1,000 at most.
* Text: hashed character trigrams, whose counts by declared language come from all documents, with an even share of noise. Trigrams of a text aren't
  independent, so the log-likelihood counts as at most EFFECTIVE trigrams' worth. A class ``und`` with evenly spread
  trigrams stands for what is no language.
* Declared language, markup language and address suffix: each is right with a known reliability, else any other.
* Host prior: the sums of text posteriors by host, smoothed towards the host's domain, smoothed towards all documents
  (a document's own share is taken out of its host). Grouped sums only, so a host with a third of all rows is summed before the shuffle.

A document is rejected if its best language is ``und`` or its posterior is below MIN_CONFIDENCE.

Cases: null and empty texts, and texts without letters, have no text evidence and no language: they're rejected; null declared
values, hosts and addresses are no evidence, nor are declared values that are no class; rows equal in id and text are decided once; a null id is an id like others; an empty table
returns no rows; without any declared language every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retrieva.session import materialize, ship_package

from .common import broadcast_if_small, small_batches

UNKNOWN = "und"
#: Documents that must declare a language, and their share of those that declare any, for it to be a class: odd values aren't learnt.
MIN_DOCUMENTS, MIN_SHARE = 10, 0.001
#: Buckets of hashed trigrams: the model has (languages x buckets) numbers of 4 bytes, 64 KB for each language, 64 MB at most.
BUCKETS = 1 << 14
EFFECTIVE, MIN_CONFIDENCE, UNKNOWN_PRIOR = 60, 0.5, 0.01
#: Share of a text's trigrams that belong to no language (keys, names, numbers with letters), so that a few don't outweigh the rest.
NOISE = 0.1
#: Reliability of each kind of declaration.
RELIABLE = {"declared": 0.9, "markup": 0.9, "suffix": 0.7}
#: Strength of the priors of domain and of all documents.
STRENGTH = 20.0
#: Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr",
            "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "hu": "hu",
            "gr": "el", "tr": "tr", "ru": "ru", "ua": "uk", "jp": "ja", "cn": "zh", "kr": "ko"}


def trigrams(text: str) -> np.ndarray:
    """Hash bucket of each character trigram of the lower-cased text; what isn't a letter counts as one space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = ((c >= 97) & (c <= 122)) | (c >= 0xAA)
    c = np.where(letter, c, np.uint32(32))
    c = c[np.concatenate(([True], letter[1:] | letter[:-1]))]
    if len(c) < 3 or not letter.any():
        return np.empty(0, np.int64)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ h >> np.uint32(15)) & np.uint32(BUCKETS - 1)).astype(np.int64)


def languages(docs: DataFrame, declared_col: str = "lang", least: int = MIN_DOCUMENTS, share: float = MIN_SHARE) -> list[str]:
    """The classes, in order: declared languages with enough documents (1 / ``share`` at most reach the driver)."""
    counts = docs.groupBy(F.col(declared_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).filter(f"trim(lang) != '' AND lang != '{UNKNOWN}'")
    counts = materialize(counts, "lang-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return sorted(r["lang"] for r in counts.filter(F.col("n") >= max(least, share * total)).collect())


def train(docs: DataFrame, classes: list[str], text_col: str = "text", declared_col: str = "lang") -> np.ndarray:
    """Log-probability of each bucket in each language, ``und`` last, from the trigram counts of all documents."""
    number = {x: i for i, x in enumerate(classes)}

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in it:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if text:
                    mine = sums.setdefault(number[lang], np.zeros(BUCKETS, np.int64))
                    mine += np.bincount(trigrams(text), minlength=BUCKETS)
        for at, mine in sums.items():
            bucket = np.flatnonzero(mine)
            yield pd.DataFrame({"at": np.full(len(bucket), at, np.int32), "bucket": bucket.astype(np.int32), "n": mine[bucket]})

    counts = np.zeros((len(classes), BUCKETS))
    if classes:
        known = docs.select(F.col(declared_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isin(*classes))
        rows = known.mapInPandas(count, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[rows["at"], rows["bucket"]] = rows["n"]
    smooth = counts + 0.5 * (counts.sum(0) + 1) / (counts.sum() + BUCKETS) * BUCKETS
    logp = np.log((1 - NOISE) * smooth / smooth.sum(1, keepdims=True) + NOISE / BUCKETS)
    return np.vstack([logp, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32)


def _agrees(kind: str, column: str, classes: list[str]) -> Column:
    """log P(column | L) for each class, ``und`` last; null or a value that is no class: no evidence."""
    none = F.array_repeat(F.lit(0.0), len(classes) + 1)
    if len(classes) < 2:
        return none
    right, wrong = float(np.log(RELIABLE[kind])), float(np.log((1 - RELIABLE[kind]) / (len(classes) - 1)))
    at = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(column))
    each = F.transform(F.sequence(F.lit(1), F.lit(len(classes))), lambda i: F.when(i == at, right).otherwise(wrong))
    return F.when(at > 0, F.concat(each, F.array(F.lit(float(np.log(1 / len(classes))))))).otherwise(none)


def _posterior(logs: Column) -> Column:
    """Normalised from an array of log weights."""
    w = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(w, lambda x: x / _total(w))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, y: s + y)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1)


def identify(docs: DataFrame, evidence: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """(_id, _th, language, confidence, kept), one row for each distinct (id, text hash) of ``docs``.

    evidence(id, markup, host), at most one row for an id: markup language, and an address's host that takes the place of ``host_col``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    names = languages(docs, declared_col)
    model = spark.sparkContext.broadcast(train(docs, names, text_col, declared_col))
    classes = len(names) + 1

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logp = model.value
        for pdf in it:
            out = []
            for text in pdf.pop("_text"):
                t = trigrams(text) if text else ()
                out.append(logp[:, t].sum(1, dtype=np.float64) * (min(len(t), EFFECTIVE) / len(t)) if len(t) else np.zeros(0))
            yield pdf.assign(_ll=out)

    read = docs.select(F.col(id_col).cast("string").alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(declared_col).alias("_declared"),
                       F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text"))
    scored = materialize(read.mapInPandas(score, "_id string, _th long, _declared string, _host string, _ll array<double>"), "lang-text").dropDuplicates(["_id", "_th"])
    if evidence is not None:
        e = evidence.select(F.col("id").cast("string").alias("_e"), F.col("markup").alias("_markup"), F.col("host").alias("_page"))
        scored = scored.join(e, F.col("_id") == F.col("_e"), "left").withColumn("_host", F.coalesce("_page", "_host")).drop("_e", "_page")
    else:
        scored = scored.withColumn("_markup", F.lit(None).cast("string"))
    last = F.lower(F.regexp_extract("_host", "\\.([^.]+)$", 1))
    scored = scored.withColumn("_domain", F.nullif(domain_of(F.col("_host")), F.lit(""))).withColumn(
        "_suffix", F.coalesce(*[F.when(last == s, x) for s, x in SUFFIXES.items()]))
    has = F.size("_ll") == classes
    scored = materialize(scored.withColumn("_p", F.when(has, _posterior(F.col("_ll")))), "lang-scored")

    sums = [F.sum(F.col("_p")[i]).alias(f"s{i}") for i in range(classes)]

    def summed(df: DataFrame, name: str) -> DataFrame:
        """The sums of each class as one array."""
        return df.withColumn(name, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(classes)])).drop(*[f"s{i}" for i in range(classes)])

    hosts = materialize(scored.filter("_host IS NOT NULL").groupBy("_host", "_domain").agg(*sums), "lang-host-sums")
    domains = summed(hosts.filter("_domain IS NOT NULL").groupBy("_domain").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(classes)]), "_d")
    whole = np.array([float(x or 0) for x in scored.agg(*sums).first()]) + 1.0
    whole[-1] = UNKNOWN_PRIOR * whole[:-1].sum() or 1.0
    whole /= whole.sum()
    every = F.array(*[F.lit(float(x)) for x in whole])

    def smoothed(values: Column, n: Column, towards: Column) -> Column:
        return F.zip_with(values, towards, lambda x, t: (x + STRENGTH * t) / (n + STRENGTH))

    hosts = summed(hosts, "_sums").join(domains, "_domain", "left").withColumn("_d", F.coalesce("_d", F.array_repeat(F.lit(0.0), classes)))
    hosts = materialize(hosts.select(F.col("_host").alias("_h"), "_sums", smoothed(F.col("_d"), _total(F.col("_d")), every).alias("_near")), "lang-hosts")
    s = scored.join(broadcast_if_small(hosts), F.col("_host") == F.col("_h"), "left")
    others = F.zip_with("_sums", "_p", lambda x, y: x - y)
    prior = F.when(F.col("_h").isNull(), every).otherwise(smoothed(others, _total(F.col("_sums")) - 1, F.col("_near")))
    logs = _plus(F.col("_ll"), F.transform(prior, lambda x: F.log(F.greatest(F.lit(0.0), x) + 1e-9)))
    for kind in RELIABLE:
        logs = _plus(logs, _agrees(kind, f"_{kind}", names))
    s = s.withColumn("_logs", F.when(has, logs)).withColumn("_post", _posterior(F.col("_logs")))
    best = F.array_max(F.transform("_post", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    s = s.withColumn("_best", best)
    language = F.coalesce(F.get(F.array(*[F.lit(x) for x in (*names, UNKNOWN)]), -F.col("_best.i")), F.lit(UNKNOWN))
    s = s.withColumn("language", language).withColumn("confidence", F.coalesce("_best.p", F.lit(0.0)))
    return s.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("confidence") >= MIN_CONFIDENCE)).select("_id", "_th", "language", "confidence", "kept")


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, markup, host): markup language and host of the page (the first by page_id) whose address ends in a document's id."""
    from .urls import host_of

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    p = p.select("page_id", F.expr("try_cast(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1) AS bigint)").alias("id"), host_of(F.col("url")).alias("host"),
                 F.lower(F.substring(F.regexp_extract("html", "<html[^>]*\\slang\\s*=\\s*[\"']?([A-Za-z]+)", 1), 1, 2)).alias("markup"))
    first = p.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("page_id", "host", "markup")).alias("first"))
    return first.select("id", F.nullif("first.markup", F.lit("")).alias("markup"), F.nullif("first.host", F.lit("")).alias("host"))


def with_languages(docs: DataFrame, decided: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """``docs``, which holds xxhash64(text) in ``hash_col``, with language, confidence and kept."""
    on = F.col(id_col).cast("string").eqNullSafe(F.col("_id")) & (F.col(hash_col) == F.col("_th"))
    return docs.join(decided, on).drop("_id", "_th")


def keep_identified(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected, ``lang_col`` set to the language found. Only rows that change are joined, by one plan at every size."""
    changed = with_languages(docs.select(id_col, F.col(lang_col).alias("__li_said"), F.xxhash64(text_col).alias("__li_hash")), decided, id_col, "__li_hash")
    changed = changed.filter(~F.col("kept") | ~F.col("__li_said").eqNullSafe(F.col("language"))).select(
        F.col(id_col).alias("__li_id"), "__li_hash", F.col("language").alias("__li_lang"), F.col("kept").alias("__li_keep")).dropDuplicates(["__li_id", "__li_hash"])
    changed = materialize(changed, "lang-changed")
    on = F.col(id_col).eqNullSafe(F.col("__li_id")) & (F.col("__li_own") == F.col("__li_hash"))
    out = docs.withColumn("__li_own", F.xxhash64(text_col)).join(changed.hint("merge"), on, "left").filter(F.coalesce("__li_keep", F.lit(True)))
    return out.withColumn(lang_col, F.coalesce("__li_lang", lang_col)).select(*docs.columns)
