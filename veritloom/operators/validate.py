"""Rules for statements and edges; a violation is a (rule, description, suggestion)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, strip, words

# Pronouns, articles and conjunctions, patterns of several claims.
PRONOUNS = "this that it they these those he she him her them".split()
GUARD_PRONOUNS = "this that it they these those".split()
LIGHT_WORDS = "the a an and or but in on at to for".split()
SEVERAL_CLAIMS = (r"(?d)\b(and|or)\b.*\b(and|or)\b", r";\s*[\p{L}\p{N}_]+", r"\.\s+[\p{L}\p{N}_]+")
EMBEDDED_CLAIMS = (r"\bwhich\b", r"(?d)\bthat\b.*\band\b", r",\s*and\b")
# Edge types with category, whether a weight is needed, and node types of either end.
EDGE_TYPES = [
    ("related_to", "weighted", True, ["atomic"], ["atomic"]),
    ("derived_from", "directed", False, ["atomic"], ["atomic"]),
    ("refines", "directed", False, ["atomic"], ["atomic"]),
    ("depends_on", "directed", False, ["atomic"], ["atomic"]),
    ("authored_by", "directed", False, ["context"], ["atomic", "context"]),
    ("appears_in", "directed", False, ["atomic"], ["context"]),
]


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def _first(found: Column) -> Column:
    return F.regexp_replace(F.get(found, F.lit(0)), r"^[.,;:!?]+|[.,;:!?]+$", "")


def _share(found: Column) -> Column:
    hits = F.size(F.filter(found, lambda w: w.isin(PRONOUNS)))
    return F.when(F.size(found) > 0, hits / F.size(found)).otherwise(F.lit(0.0))


def first_word(statement: Column) -> Column:
    return _first(words(F.lower(statement)))


def pronoun_start(statement: Column) -> Column:
    return first_word(statement).isin(PRONOUNS)


def pronoun_density(statement: Column) -> Column:
    """The share of words that are pronouns (0 without words)."""
    return let(words(F.lower(statement)), _share)


def multi_sentence(statement: Column) -> Column:
    return statement.rlike(r"[.!?]+\s+[A-Z]")


def multi_claim(statement: Column) -> Column:
    return _any(statement, SEVERAL_CLAIMS)


def embedded_clause(statement: Column) -> Column:
    return let(F.lower(statement), lambda low: _any(low, EMBEDDED_CLAIMS))


def too_short(statement: Column) -> Column:
    return F.length(strip(statement)) < 10


def _light(found: Column) -> Column:
    return F.size(F.filter(found, lambda w: ~w.isin(LIGHT_WORDS))) < 3


def lacks_content(statement: Column) -> Column:
    return _light(words(F.lower(statement)))


def violations(statement: Column, strict: bool = True) -> Column:
    """Array of violations: at most one of each check, in the order of checks."""
    return let(F.struct(words(F.lower(statement)).alias("words"), statement.alias("text")), lambda s: _violations(s["text"], s["words"], strict))


def _violations(statement: Column, found: Column, strict: bool) -> Column:
    v = lambda rule, description, suggestion: F.struct(F.lit(rule).alias("rule"), description.alias("description"), F.lit(suggestion).alias("suggestion"))
    containment = F.when(F.size(found) == 0, v("SELF_CONTAINMENT", F.lit("Statement is empty"), "Provide a complete statement")).when(
        _first(found).isin(PRONOUNS),
        v("SELF_CONTAINMENT", F.concat(F.lit("Statement starts with dependency pronoun '"), _first(found), F.lit("'")), "Replace pronoun with explicit subject"),
    )
    if strict:
        containment = containment.when(_share(found) > 0.25, v("SELF_CONTAINMENT", F.lit("High pronoun density suggests context dependency"), "Make references explicit"))
    claim = (
        F.when(multi_sentence(statement), v("SINGLE_CLAIM", F.lit("Statement contains multiple sentences"), "Split into separate atomic statements"))
        .when(multi_claim(statement), v("SINGLE_CLAIM", F.lit("Statement contains multiple claims joined by conjunction"), "Split into separate atomic statements"))
        .when(embedded_clause(statement), v("SINGLE_CLAIM", F.lit("Statement may contain multiple embedded claims"), "Split into separate atomic statements"))
    )
    short = F.when(too_short(statement), v("MINIMUM_LENGTH", F.lit("Statement too short to be meaningful"), "Provide more complete statement"))
    content = F.when(_light(found), v("MEANINGFUL_CONTENT", F.lit("Statement lacks sufficient semantic content"), "Provide more substantive claim"))
    return F.array_compact(F.array(containment, claim, short, content))


def reason(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: x["description"]), "; ")


def suggest_repair(statement: Column, context: Column, strict: bool = True) -> Column:
    """Possible atomic statements in place of an invalid one."""
    pieces = F.filter(F.transform(F.split(statement, r"[.!?]+\s+", -1), strip), lambda s: s != "")
    split = F.when(F.size(F.split(statement, r"[.!?]+\s+", -1)) > 1, F.transform(pieces, lambda s: F.concat(s, F.lit("."))))
    own = words(statement)
    subjects = F.filter(words(F.coalesce(context, F.lit(""))), lambda w: w.rlike(r"^\p{Lu}.")) 
    pronoun = F.lower(F.get(own, F.lit(0))).isin(PRONOUNS) & (F.size(subjects) > 0)
    resolved = F.when(pronoun, F.array(F.concat(F.element_at(F.when(F.size(subjects) > 0, subjects), -1), F.lit(" "), F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), " "))))
    empty = F.array().cast("array<string>")
    found = F.concat(F.coalesce(split, empty), F.coalesce(resolved, empty))
    return F.when((F.size(violations(statement, strict)) == 0) | (F.size(found) == 0), F.array(statement)).otherwise(found)


def node_guard(statement: Column) -> Column:
    """Whether a statement may become a node."""
    return (F.length(statement) >= 10) & ~F.coalesce(F.get(words(F.lower(statement)), F.lit(0)).isin(GUARD_PRONOUNS), F.lit(False))


def edge_weight_guard(type_: Column, weight: Column) -> Column:
    """A weight in [0, 1] for related_to, none for the others."""
    return F.when(type_ == "related_to", F.coalesce((weight >= 0) & (weight <= 1), F.lit(False))).otherwise(weight.isNull())


def containment_guard(type_: Column) -> Column:
    return ~type_.rlike("contains|has|includes|part_of")


def edge_type_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_TYPES, "type string, category string, requires_weight boolean, sources array<string>, targets array<string>")


def endpoint_check(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (source, target, type) with ``valid``: both ends exist and have allowed types."""
    rules = F.broadcast(edge_type_rules(edges.sparkSession).select("type", "sources", "targets"))  # six rows
    kinds = nodes.select("node_id", "node_type")
    joined = (
        edges.join(kinds.select(F.col("node_id").alias("source"), F.col("node_type").alias("_s")), "source", "left")
        .join(kinds.select(F.col("node_id").alias("target"), F.col("node_type").alias("_t")), "target", "left")
        .join(rules, "type", "left")
    )
    valid = F.array_contains("sources", F.col("_s")) & F.array_contains("targets", F.col("_t"))
    return joined.withColumn("valid", F.coalesce(valid, F.lit(False))).select(*edges.columns, "valid")


