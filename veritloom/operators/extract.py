"""Statement extraction: sentences, bullets and numbered items with their spans.

Spans are half-open intervals of code points.  Everything is a column
expression over one text, so a corpus needs no shuffle here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, meta_filter, strip, strip_left

UNIT = "struct<text:string,start:int,end:int,context:string>"
_LEAST = 10
_AROUND = 100
#: Code points of a block: a stretch of a text is read from its blocks, as the text has no index of its code points.
_BLOCK = 256
#: Numbers that are summed up, and units that are appended, in one list.
_SUMMED = 256
#: Longest text that is sought as a literal pattern.
_LITERAL = 1000


def _none() -> Column:
    return F.array().cast(f"array<{UNIT}>")


def _unit(text: Column, start: Column, end: Column, context: Column) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), context.alias("context"))


def _blocks(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _around(blocks: Column, start: Column, end: Column) -> Column:
    """A stretch with what is around it, in time that does not depend on where it stands."""

    def cut(span: Column) -> Column:
        first = F.floor(span["begin"] / _BLOCK)
        own = F.slice(blocks, (first + 1).cast("int"), (F.floor((span["end"] - 1) / _BLOCK) - first + 1).cast("int"))
        return F.substring(F.array_join(own, ""), (span["begin"] - first * _BLOCK + 1).cast("int"), (span["end"] - span["begin"]).cast("int"))

    return let(F.struct(F.greatest(start - _AROUND, F.lit(0)).alias("begin"), (end + _AROUND).alias("end")), cut)


def _running(sizes: Column, base: Column) -> Column:
    return F.aggregate(
        sizes,
        F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )


def _sums(sizes: Column) -> Column:
    """What comes before each number, in sum: lists of _SUMMED numbers, and the sums of the lists before them."""
    zero = F.lit(0)
    return let(_lists(sizes), lambda some: F.flatten(F.zip_with(some, _running(F.transform(some, lambda s: F.aggregate(s, zero, lambda acc, n: acc + n)), zero), _running)))


def _parts(content: Column, pattern: str, units, **more: Column) -> Column:
    """``units`` of the struct (gaps, starts, blocks, ...): the gaps between the matches of a pattern and where each begins."""

    def placed(found: Column) -> Column:
        sizes = F.transform(found["gaps"], lambda g, i: F.length(g) + F.coalesce(F.length(F.get(found["hits"], i)), F.lit(0)))
        return let(F.struct(*(found[k].alias(k) for k in ("gaps", "hits", "blocks", *more)), _sums(sizes).alias("starts")), units)

    gaps, hits = F.split(content, pattern, -1), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    return let(F.struct(gaps.alias("gaps"), hits.alias("hits"), _blocks(content).alias("blocks"), *(c.alias(k) for k, c in more.items())), placed)


def _first(content: Column, text: Column) -> Column:
    """Where a text that is not empty first occurs, from 0; -1 where it does not.

    A literal pattern skips by the length of the text; longer texts are few.
    """
    literal = F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    before = let(F.split(content, literal, 2), lambda parts: F.when(F.size(parts) > 1, F.length(F.get(parts, F.lit(0)))).otherwise(F.lit(-1)))
    return F.when(F.length(text) > _LITERAL, F.instr(content, text) - 1).otherwise(before)


def sentences(content: Column) -> Column:
    """Stretches between sentence ends, stripped, longer than ten characters."""

    def units(parts: Column) -> Column:
        def found(piece: Column, i: Column) -> Column:
            return F.struct(strip(piece).alias("text"), (F.get(parts["starts"], i) + F.length(piece) - F.length(strip_left(piece))).alias("start"))

        def one(u: Column) -> Column:
            end = u["start"] + F.length(u["text"])
            return _unit(u["text"], u["start"], end, _around(parts["blocks"], u["start"], end))

        return F.transform(F.filter(F.transform(parts["gaps"], found), lambda u: F.length(u["text"]) > _LEAST), one)

    return _parts(content, r"[.!?]+\s+", units)


def bullets(content: Column) -> Column:
    """Bulleted lines; the span is the line's first occurrence, the context its neighbours."""
    mark = r"^\s*[-•*]\s+"

    def units(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(lines, i - 1))
            return let(_first(content, line), lambda start: _unit(strip(F.regexp_replace(line, mark, "")), start, start + F.length(line), F.concat_ws("\n", before, line, F.get(lines, i + 1))))

        marked = F.transform(lines, lambda line, i: F.when(line.rlike(mark), one(line, i)))
        return F.filter(marked, lambda u: u.isNotNull() & (F.length(u["text"]) > _LEAST))

    return let(F.split(content, "\n"), units)


def numbered(content: Column) -> Column:
    """Numbered lines; the span is the whole match, blank lines before it included."""
    item = r"(?md)^\s*\d+\.\s+(.+)$"

    def units(parts: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            start = F.get(parts["starts"], i) + F.length(F.get(parts["gaps"], i))
            end = start + F.length(hit)
            return _unit(strip(F.get(parts["texts"], i)), start, end, _around(parts["blocks"], start, end))

        return F.filter(F.transform(parts["hits"], one), lambda u: F.length(u["text"]) > _LEAST)

    return _parts(content, item, units, texts=F.regexp_extract_all(content, F.lit(item), F.lit(1)))


def _lists(values: Column) -> Column:
    """``values`` in lists of _SUMMED."""
    return let(values, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(s) - 1) / _SUMMED), F.lit(0)).cast("int")), lambda k: F.slice(s, k * _SUMMED + 1, F.lit(_SUMMED))))


def drop_overlaps(units: Column) -> Column:
    """By start, then length, then order: a unit goes if it begins before the last kept one ends."""
    keyed = F.transform(units, lambda u, i: F.struct(u["start"].alias("start"), (u["end"] - u["start"]).alias("size"), i.alias("seq"), u.alias("unit")))

    def kept(some: Column, last: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(last.alias("last"), _none().alias("out")),
            lambda acc, x: F.when(x["start"] < acc["last"], acc).otherwise(F.struct((x["start"] + x["size"]).alias("last"), F.concat(acc["out"], F.array(x["unit"])).alias("out"))),
        )

    def step(acc: Column, some: Column) -> Column:
        return let(F.struct(acc.alias("acc"), kept(some, acc["last"]).alias("new")), lambda s: F.struct(s["new"]["last"].alias("last"), F.concat(s["acc"]["out"], s["new"]["out"]).alias("out")))

    return F.aggregate(_lists(F.sort_array(keyed)), F.struct(F.lit(-1).alias("last"), _none().alias("out")), step)["out"]


def remap(units: Column, original: Column) -> Column:
    """Spans as first occurrences in the original text; units that it lacks go."""

    def one(u: Column) -> Column:
        return let(_first(original, u["text"]), lambda start: F.when(start >= 0, _unit(u["text"], start, start + F.length(u["text"]), u["context"])))

    return F.filter(F.transform(units, one), lambda u: u.isNotNull())


def parse(content: Column, strict: bool = False) -> Column:
    """All units of a text, in order."""
    clean = meta_filter(content, strict)
    return remap(let(clean, lambda c: drop_overlaps(F.concat(bullets(c), numbered(c), sentences(c)))), content)


def explode_units(docs: DataFrame, units: Column, *keep: str) -> DataFrame:
    """A row per unit: the kept columns, ord (from 0), text, start, end, context."""
    return docs.select(*keep, F.posexplode(units).alias("ord", "unit")).select(
        *keep, F.col("ord").cast("bigint").alias("ord"), "unit.text", F.col("unit.start").cast("bigint").alias("start"), F.col("unit.end").cast("bigint").alias("end"), "unit.context"
    )
