"""Quality rules: base text statistics and a likelihood ratio of hashed n-grams.

SQL functions only.  Words and pairs of neighbouring words are hashed to
``BUCKETS`` features.  Two multinomials are counted: of the *raw corpus* (all
documents, in full) and of the *trusted target* (every document that labels call
good, whole texts).  A document's score is the mean over its n-grams of
``log(p_target / p_raw)``, with add-one smoothing; a document is kept if the
score reaches ``threshold``.  Every document is scored and decided by the same
rule; nothing is drawn at random.

The threshold is the mean score of all trusted documents minus ``SPREADS``
standard deviations, so ordinary text passes whatever the features' number; no
trusted document means no verdict, and the
base rules decide alone.

Labels may cover any share of the corpus.  Their ids are merged with those of
documents behind an id filter, never broadcast: for the counts, the texts that
pass the filter are shuffled once; for the threshold, their scores.

Defined results: a null or empty text has no words and fails the base rules;
null ids keep their null and are never trusted; rows with equal ids are
documents of their own; a label given twice counts once; without labels the
score is 0; an empty table gives no rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_possible_ids

#: Hashed features; the tables of both multinomials have this many rows.
BUCKETS = 1 << 14
#: Standard deviations below the trusted mean that still pass.
SPREADS = 4.0
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(_without(text, _SYMBOLS))


def word_chars(text: Column) -> Column:
    return F.length(_without(text, " \t\n\x0b\x0c\r"))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def windows(words: Column) -> Column:
    """A hash of every window of three words."""
    last = F.greatest(F.size(words) - 2, F.lit(0))
    return F.transform(F.slice(words, F.lit(1), last), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def n_repeat_words(words: Column, windows: Column) -> Column:
    """Words covered by a window of three that occurs twice or more.

    Equal windows stand next to each other after sorting (hash, place); the
    places of those that have an equal neighbour, in order, cover three words
    each, less what the one before covered.
    """

    def repeated(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        return F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))

    twice = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def _feature(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def features(words: Column) -> Column:
    """Features of all words and of all pairs of neighbours."""
    single = F.transform(words, lambda w: _feature(w))
    pairs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: _feature(w, F.get(words, i + 1)))
    return F.concat(single, pairs)


def score_of(words: Column, ratios: Column) -> Column:
    total = F.aggregate(features(words), F.lit(0.0), lambda acc, f: acc + F.get(ratios, f))
    return total / F.greatest(2 * F.size(words) - 1, F.lit(1))


def good_ids(labels: DataFrame) -> DataFrame:
    """The ids, once each, of all documents that labels call good."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("_good")).distinct()


def with_good_id(rows: DataFrame, good: DataFrame) -> DataFrame:
    """Rows whose doc_id is among ``good``, merged at every size: ids grow with the corpus."""
    return rows.join(good.hint("merge"), F.col("doc_id") == F.col("_good")).drop("_good")


def feature_counts(docs: DataFrame) -> list[int]:
    """Occurrences by feature: BUCKETS numbers, whatever the corpus."""
    each = docs.select(F.explode(let(words_of(F.col("text")), features)).alias("feature"))
    counts = [0] * BUCKETS
    for feature, n in each.groupBy("feature").agg(F.count("*")).collect():
        counts[feature] = n
    return counts


def log_ratios(raw: list[int], target: list[int]) -> list[float]:
    """``log(p_target / p_raw)`` by feature."""
    n_raw, n_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [math.log((t + 1) / n_target) - math.log((r + 1) / n_raw) for r, t in zip(raw, target, strict=True)]


def trusted_model(docs: DataFrame, labels: DataFrame | None) -> tuple[Column, float | None, float | None]:
    """The ratios, and mean and spread of the scores of trusted documents, if any."""
    if labels is None:
        return constant_array([0.0] * BUCKETS), None, None
    good = good_ids(labels)
    docs = docs.select("doc_id", "text")
    possible = keep_possible_ids(docs, "doc_id", good, "_good")
    target = feature_counts(with_good_id(possible, good))
    ratios = constant_array(log_ratios(feature_counts(docs), target) if any(target) else [0.0] * BUCKETS)
    # Short texts are left out by the aggregate, as a condition would be pushed below the id filter and split every text.
    scored = possible.select("doc_id", let(words_of(F.col("text")), lambda words: F.when(F.size(words) >= LEAST_WORDS, score_of(words, ratios))).alias("score"))
    mean, spread = with_good_id(scored, good).agg(F.avg("score"), F.stddev_pop("score")).first()
    return ratios, mean, spread


def constant_array(values: list[float]) -> Column:
    """An array as one constant of the plan."""
    return F.split(F.lit(",".join("%.9g" % v for v in values)), ",").cast("array<double>")


def quality_rules(
    docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", spreads: float = SPREADS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept of every row.

    Columns named in ``carry`` come along.
    """
    docs = docs.select(*carry, F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ratios, mean, spread = trusted_model(docs, labels)

    text = F.col("text")

    def measures(words: Column) -> Column:
        repeated = let(windows(words), lambda found: n_repeat_words(words, found))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            repeated.cast("bigint").alias("n_repeat_words"),
            score_of(words, ratios).alias("score"),
        )

    measured = docs.select(
        *carry,
        "doc_id",
        word_chars(text).cast("bigint").alias("word_chars"),
        n_symbols(text).cast("bigint").alias("n_symbols"),
        n_dup_lines(text).cast("bigint").alias("n_dup_lines"),
        let(words_of(text), measures).alias("m"),
    ).select(*carry, "doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.score")
    least = None if mean is None else mean - spreads * spread
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    verdict = F.lit(True) if least is None else F.col("score") >= least
    return measured.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & verdict)
