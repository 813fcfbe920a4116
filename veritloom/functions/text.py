"""Column functions on text: cleaning, hashing, terms and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content, by the operator that drops them.
TERM_STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would should could may might must can this that these those it its they them their"
).split()
VECTOR_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare "
    "ought used to of in for on with at by from as into through during before after above below and but or nor so yet both "
    "either neither not no that this these those it its their they he she we i you who which what than then when where how "
    "all each every some any most more other such only also there here up out about over just very"
).split()

_SPACE = r"(?U)\s+"
#: Unicode white space, as ``(?U)\s`` knows it.
_BLANK = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; what a lambda names is otherwise computed for each of its rows."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(_BLANK))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(_BLANK))


def words(text: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def stability_hash(statement: Column) -> Column:
    return F.substring(F.sha2(F.lower(strip(statement)), 256), 1, 16)


def node_id(statement: Column) -> Column:
    return F.concat(F.lit("atomic_"), stability_hash(statement))


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def context_id(content: Column) -> Column:
    return F.concat(F.lit("context_"), content_hash(content))


def meta_filter(content: Column, strict: bool = False) -> Column:
    """Without quoted blocks and lines that begin with a hash sign.

    ``strict`` also drops three-apostrophe blocks and lines of ``//`` comments.
    """
    blocks = r'"""[\s\S]*?"""|' + ("'''[\\s\\S]*?'''" if strict else "''''[\\s\\S]*?''''")
    out = F.regexp_replace(F.regexp_replace(content, blocks, ""), r"(?md)^\s*#.*$", "")
    return F.regexp_replace(out, r"(?md)^\s*//.*$", "") if strict else out


def canonical_terms(text: Column, most: int = 5) -> Column:
    """Capitalised words, then long words in lower case; distinct, in order of first sight."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), 0)
    stop = strings(TERM_STOPWORDS)
    names = F.filter(tokens(text), lambda w: w.rlike("^[A-Z][a-z]+$"))
    long = F.filter(tokens(F.lower(text)), lambda w: F.length(w) > 6)
    kept = F.filter(F.array_distinct(F.concat(names, long)), lambda w: ~F.array_contains(stop, F.lower(w)))
    return F.slice(kept, 1, most)


def normalise_labels(reply: Column) -> Column:
    """Up to three clean labels of a comma-separated reply, or ``general``."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(strip(x)), "[\"'.;:!?]", ""), r"\s+", "-")
    found = F.filter(F.transform(F.split(reply, ","), clean), lambda x: F.length(x) > 1)
    return F.slice(let(found, lambda x: F.when(F.size(x) == 0, strings(["general"])).otherwise(x)), 1, 3)


def parse_label_reply(reply: Column, expected: Column) -> Column:
    """Labels of statements 1..expected from lines ``n: a, b``; a later line of a number wins."""
    pattern = F.lit(r"(?m)^(\d+):[ \t]*(\S.*)$")
    numbers, texts = F.regexp_extract_all(reply, pattern, 1), F.regexp_extract_all(reply, pattern, 2)
    pairs = F.arrays_zip(numbers.alias("n"), texts.alias("t"))

    def of(i: Column) -> Column:
        mine = F.filter(pairs, lambda p: p["n"].cast("int") == i)
        return F.coalesce(normalise_labels(F.element_at(F.when(F.size(mine) > 0, mine), -1)["t"]), strings(["general"]))

    return F.when(expected < 1, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), of))


def display_label(statement: Column, length: int, ellipsis: str = "") -> Column:
    return F.concat(F.substring(F.coalesce(statement, F.lit("")), 1, length), F.lit(ellipsis))


def hex_seed(digest: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
