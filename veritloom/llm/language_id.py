"""Language identification by Bayesian fusion of four kinds of evidence.

* *Text.*  Naive Bayes over hashed byte trigrams of letters, fitted on a bounded
  sample of labelled documents (``SAMPLE`` ids of least hash, whole texts).  A
  text counts for at most ``EFFECTIVE`` independent trigrams, so that it stays
  comparable with the other evidence.
* *Declared markup language* and *address mark* (a language code in the path,
  else the host's last label): the likelihood of each value under every
  language, smoothed, from soft counts over all rows.
* *Host prior.*  The languages of a host's other rows, smoothed towards those
  of its domain, and these towards those of all rows.

Fusion tells which of the known languages it is, not whether it is one at all.
For that, the text's most likely language is held against a background that
draws any trigram alike: ``margin`` is the mean gain per trigram in log
likelihood.  A row is kept if its language is probable enough and the margin is
not negative; most trigrams of a text in no known language are rarer in each of
the known ones than by chance, and its margin is far below.

Soft counts are sums of every row's text posterior, by grouped aggregation; a
row's own share is taken out of its host's.  Declared values and marks fall
into a fixed number of classes, so their tables are broadcast; hosts are
joined by a shuffle that may split a hot host.

Defined results: a null or empty text has no features and is judged by the
other evidence; null or malformed addresses and missing declarations are values
of their own; rows with null or equal ids are rows of their own; ties go to the
language first in alphabetical order; without labelled rows every language is
null and nothing is kept; equal rows of the sample count once; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled documents that the text model is fitted on, at most.
SAMPLE = 4096
#: Hashed trigrams.
FEATURES = 1 << 15
#: Independent trigrams that a text counts for, at most.
EFFECTIVE = 200.0
#: Weight of the wider level in rows, for hosts, domains and likelihoods.
SMOOTHING = 5.0
#: Classes of address marks.
MARKS = 4096
#: A row is kept if its language is at least this probable.
CONFIDENCE = 0.5

_TO_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_DROPPED = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def strip_markup(page: str | None) -> str:
    """The text of an HTML page."""
    return html.unescape(_DROPPED.sub(" ", page or ""))


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of a text's letters (of bytes, within or at the border of words)."""
    raw = np.frombuffer(b" " + (text or "").lower().encode().translate(_TO_LETTERS) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    codes = (a << np.uint32(16) | b << np.uint32(8) | c)[(b != 32) & ((a != 32) | (c != 32))]
    return ((codes * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _labelled(training: DataFrame, sample: int) -> DataFrame:
    """Up to ``sample`` labelled rows (text, lang), by least hashes of id and text."""
    usable = training.where("id is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"), F.struct(F.xxhash64("id"), F.xxhash64("text")).alias("h"))
    edge = usable.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return usable.limit(0).select("text", "lang")
    return usable.where(F.col("h") <= F.struct(F.lit(edge[0]), F.lit(edge[1]))).distinct().select("text", "lang")


def fit(training: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log likelihoods [language, feature], log shares) of labelled rows (id, text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=FEATURES)
                docs[lang] = docs.get(lang, 0) + 1
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            features, n = np.concatenate([[-1], at]), np.concatenate([[docs[lang]], found[at]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(features, pa.int32()), pa.array(n, pa.int64())], names=["lang", "feature", "n"])

    chosen = _labelled(training, sample)
    rows = chosen.mapInArrow(count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n")).collect()
    languages = sorted({r[0] for r in rows})
    counts, docs = np.zeros((len(languages), FEATURES)), np.zeros(len(languages))
    for lang, feature, n in rows:
        k = languages.index(lang)
        if feature < 0:
            docs[k] = n
        else:
            counts[k, feature] = n
    smooth = counts + 0.5
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(docs / max(1.0, docs.sum()))


def _text_evidence(rows: DataFrame, languages: list[str], likelihood: np.ndarray, share: np.ndarray, markup: bool) -> DataFrame:
    """id, host, domain, declared, mark, n_features, margin, log_text (by language), soft (text posterior)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(likelihood.T))
    known = set(languages)
    n = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                texts = batch.column(0).to_pylist()
                declared = batch.column(1).to_pylist()
                means = np.zeros((len(texts), n))
                sizes = np.zeros(len(texts), np.int64)
                for k, text in enumerate(texts):
                    features = trigrams(strip_markup(text) if markup else text)
                    sizes[k] = len(features)
                    if len(features):
                        means[k] = table[features].mean(axis=0)
                margin = np.where(sizes > 0, means.max(axis=1) + np.log(FEATURES), 0.0)
                found = means * np.minimum(sizes, EFFECTIVE)[:, None]
                found -= found.max(axis=1, keepdims=True)
                soft = np.exp(found + share)
                soft /= soft.sum(axis=1, keepdims=True)
                classes = ["none" if not d else d if d in known else "other" for d in declared]
                ends = pa.array(np.arange(0, len(texts) * n + 1, n, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (found, soft)]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(classes), pa.array(sizes), pa.array(margin), *lists], names=names)

    names = ["id", "host", "domain", "mark", "declared", "n_features", "margin", "log_text", "soft"]
    kinds = "id bigint, host string, domain string, mark string, declared string, n_features bigint, margin double, log_text array<double>, soft array<double>"
    chosen = rows.select("text", "declared", "id", "host", "domain", "mark")
    return chosen.mapInArrow(run, kinds)


def identify(rows: DataFrame, training: DataFrame, markup: bool = False, sample: int = SAMPLE, confidence: float = CONFIDENCE) -> DataFrame:
    """id, host, declared, n_features, text_lang, margin, lang, confidence, kept of every row.

    ``rows``: id, text, declared, host, domain, mark; ``training``: id, text, lang.
    """
    languages, likelihood, share = fit(training, sample)
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("id", "host", "declared", F.lit(0).cast("bigint").alias("n_features"), none.alias("text_lang"), F.lit(0.0).alias("margin"), none.alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    seen = written(_text_evidence(rows, languages, likelihood, share, markup), "lang-text")
    sums = lambda: F.array(*(F.sum(F.get("soft", k)) for k in range(n)))
    level = lambda *by: seen.groupBy(*by).agg(sums().alias("sums"), F.count("*").cast("double").alias("n"))

    totals = seen.agg(*(F.coalesce(F.sum(F.get("soft", k)), F.lit(0.0)) for k in range(n))).first()
    every = sum(totals) + n
    prior = F.array(*(F.lit((t + 1) / every) for t in totals))
    of_language = F.array(*(F.lit(float(t)) for t in totals))

    def smoothed(counts: Column, size: Column, wider: Column) -> Column:
        return F.zip_with(counts, wider, lambda c, w: (F.greatest(c, F.lit(0.0)) + SMOOTHING * w) / (F.greatest(size, F.lit(0.0)) + SMOOTHING))

    domains = level("domain").select(F.col("domain").alias("_domain"), smoothed(F.col("sums"), F.col("n"), prior).alias("wide"))
    hosts = level("host", "domain")
    hosts = hosts.join(domains, hosts["domain"].eqNullSafe(domains["_domain"])).select(
        F.col("host").alias("_host"), F.col("domain").alias("_domain"), F.col("sums").alias("_sums"), F.col("n").alias("_n"), "wide"
    )

    def likelihoods(column: str) -> DataFrame:
        """log P(value | language), for a column with a fixed number of classes."""
        found = level(column)
        share_of = F.col("n") / F.lit(max(1.0, float(sum(totals))))
        logs = F.zip_with("sums", of_language, lambda c, t: F.log((c + SMOOTHING * share_of) / (t + SMOOTHING)))
        return F.broadcast(found.select(F.col(column).alias(f"_{column}"), logs.alias(f"log_{column}")))

    joined = (
        seen.join(hosts, seen["host"].eqNullSafe(F.col("_host")) & seen["domain"].eqNullSafe(F.col("_domain")))
        .join(likelihoods("declared"), F.col("declared") == F.col("_declared"))
        .join(likelihoods("mark"), F.col("mark") == F.col("_mark"))
    )
    others = F.zip_with("_sums", "soft", lambda c, own: c - own)
    host_prior = smoothed(others, F.col("_n") - 1, F.col("wide"))
    logs = F.zip_with(F.zip_with("log_text", "log_declared", lambda a, b: a + b), F.zip_with("log_mark", host_prior, lambda a, b: a + F.log(b)), lambda a, b: a + b)
    scored = joined.select("id", "host", "declared", "n_features", "margin", "log_text", logs.alias("logs"))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    top = F.array_max("logs")
    out = scored.select(
        "id",
        "host",
        "declared",
        "n_features",
        F.when(F.col("n_features") > 0, best(F.col("log_text"))).alias("text_lang"),
        "margin",
        best(F.col("logs")).alias("lang"),
        (F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))).alias("confidence"),
    )
    return out.withColumn("kept", (F.col("n_features") > 0) & (F.col("confidence") >= confidence) & (F.col("margin") >= 0))


def _mark(path_code: Column, host: Column) -> Column:
    """A language code from the path, else a class of the host's last label."""
    label = F.element_at(F.split(host, r"\."), -1)
    of_host = F.when(F.coalesce(F.length(host), F.lit(0)) == 0, F.lit("-")).otherwise(F.pmod(F.xxhash64(label), F.lit(MARKS)).cast("string"))
    return F.when(F.length(path_code) > 0, path_code).otherwise(of_host)


def page_rows(pages: DataFrame) -> DataFrame:
    """``identify``'s rows of web pages (page_id, url, html)."""
    url = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    code = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    return pages.select(
        F.col("page_id").cast("bigint").alias("id"),
        F.col("html").cast("string").alias("text"),
        declared.alias("declared"),
        host.alias("host"),
        F.when(F.size(F.split(host, r"\.")) >= 2, domain).otherwise(host).alias("domain"),
        _mark(code, host).alias("mark"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """``identify``'s rows of documents: the source stands for the host; a lang column, if there is one, for the declaration."""
    text = F.col("text").cast("string")
    declared = F.lower("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), text.alias("text"), declared.alias("declared"), F.col("source").cast("string").alias("host"), F.lit("").alias("domain"), F.lit("-").alias("mark"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), F.lower("lang").alias("lang"))
