"""License scan by ordered signature rules, with SQL functions only.

1. A document's words are matched against the rules' keywords; documents
   without any keyword are done.
2. Only rules whose keyword occurs are tried; each yields the word intervals of
   its matches.
3. Overlapping detections are resolved: one that lies within another of higher
   priority is suppressed, or of the same priority if it is shorter or its rule
   comes later.  Phrases of the base table are detections of their own and are
   never suppressed.

Suppression is a running maximum over a document's detections in order of
their start, so its cost does not grow with the square of their number.

Defined results: a null or empty text has no words, no detection and score 0;
null ids and rows with equal ids are documents of their own; a detection found
twice (repeated text) counts twice; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .license_rules import BASE_RULES, RULES, parsed
from .quality_rules import let

#: Between words: everything in ASCII but letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PRIORITIES = (1, 2, 3, 4)


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """(number, label, priority, confidence, keyword, pattern) of every rule, base phrases first."""
    return [(k, *r) for k, r in enumerate(parsed(BASE_RULES) + parsed(RULES))]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def spaced(words: Column) -> Column:
    """Words with two spaces between them and one at either end: each has two of its own."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def _n_words(piece: Column) -> Column:
    return F.floor((F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("int")


def intervals(text: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of all matches of a pattern in a spaced text."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + pair["hit"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(_n_words(g).alias("gap"), _n_words(h).alias("hit")))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _rule_groups() -> Column:
    """Constant: an array of (keyword, rules) in order."""
    by: dict[str, list] = {}
    for rule in rules():
        by.setdefault(rule[4], []).append(rule)
    quoted = lambda s: "r'" + s.replace("'", "''") + "'"
    one = lambda r: f"named_struct('rule', {r[0]}, 'pattern', {quoted(r[5])})"
    groups = [f"named_struct('keyword', {quoted(k)}, 'rules', array({', '.join(map(one, found))}))" for k, found in by.items()]
    return F.expr(f"array({', '.join(groups)})")


def _catalogue() -> Column:
    """Constant: label, priority and confidence by rule number."""
    rows = [f"named_struct('label', '{r[1]}', 'priority', {r[2]}, 'confidence', {r[3]}D)" for r in rules()]
    return F.expr(f"array({', '.join(rows)})")


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words, found (array of rule, start, end) of every document, before suppression."""
    keywords = F.expr("array(" + ", ".join(f"'{k}'" for k in dict.fromkeys(r[4] for r in rules())) + ")")
    groups = _rule_groups()
    text = F.coalesce(F.col("text"), F.lit(""))

    def tried(words: Column) -> Column:
        chosen = F.flatten(F.transform(F.filter(groups, lambda g: F.array_contains(words, g["keyword"])), lambda g: g["rules"]))
        matched = let(
            spaced(words),
            lambda line: F.flatten(
                F.transform(chosen, lambda r: F.transform(intervals(line, r["pattern"]), lambda x: F.struct(r["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"))))
            ),
        )
        return matched

    none = F.array().cast("array<struct<rule:int,start:int,end:int>>")
    exact = let(words_of(ascii_lower(text)), tried)
    seen = let(
        words_of(F.lower(text)),
        lambda words: F.struct(F.size(words).cast("bigint").alias("n_words"), F.arrays_overlap(words, keywords).alias("gate")),
    )
    gated = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", seen.alias("seen"))
    return gated.select("doc_id", "row", "seen.n_words", F.when(F.col("seen.gate"), exact).otherwise(none).alias("found"))


def resolve(found: DataFrame) -> DataFrame:
    """Detections (row, rule, start, end) with label, priority, confidence and whether they stay."""
    rule = F.get(_catalogue(), F.col("rule"))
    named = found.select("*", rule.alias("r")).select(*found.columns, "r.label", "r.priority", "r.confidence")
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = {f"_reach{p}": F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in _PRIORITIES}
    covered = F.lit(False)
    for p in _PRIORITIES:
        covered = F.when(F.col("priority") == p, F.coalesce(F.col(f"_reach{p}") >= F.col("end"), F.lit(False))).otherwise(covered)
    return named.withColumns(reach).withColumn("stays", (F.col("priority") == 4) | ~covered).drop(*reach)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every row.

    ``detections`` are the word intervals that stay, with rule, label, priority
    and confidence; ``score`` is the greatest confidence among them.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = written(detections(docs), "license-words")
    each = seen.where(F.size("found") > 0).select("row", F.explode("found").alias("d")).select("row", "d.*")
    base = F.col("priority") == 4
    labels = lambda keep: F.array_join(F.sort_array(F.collect_set(F.when(keep, F.col("label")))), ",")
    per_row = (
        resolve(each)
        .where("stays")
        .groupBy("row")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(F.lit(True)).alias("labels"),
            F.max("confidence").alias("score"),
            F.sort_array(F.collect_list(F.struct("start", "end", "rule", "label", "priority", "confidence"))).alias("detections"),
        )
    )
    nothing = F.array().cast("array<struct<start:int,end:int,rule:int,label:string,priority:int,confidence:double>>")
    return seen.drop("found").join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("detections", nothing).alias("detections"),
    )
