"""Page-bounded chunking as native folds over arrays, one row per page in, one per chunk out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.text import (
    DEV, gazette_numbers, joined, normalise, standard_numbers, strip_begin, strip_held, strip_ws,
)
from granthi.operators.ordering import running_sum
from granthi.session import settled

# Where a clause starts and where a long unit may be cut.
CLAUSE_START = r"(?mdU)(?=^\s*(?:\(\s*[0-9ivxa-z]{1,4}\s*\)|\d{1,2}\.\d{0,2}\s|Provided\b|PROVIDED\b))"
SENTENCE_BREAK = rf"(?U)(?<=[.;:])\s+(?=[A-Z({DEV}])"


def _not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def _cut(text: Column, target: int) -> Column:
    """Hard slices of ``target`` characters."""
    starts = F.sequence(F.lit(1), F.length(text), F.lit(target))
    return F.transform(starts, lambda i: strip_ws(F.substring(text, i, F.lit(target))))


def _repack(unit: Column, target: int) -> Column:
    """Sentences of a long unit packed greedily; an overlong sentence is cut hard. Sentences of a stripped unit have no blank at either end."""
    empty = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        buf, out = state["buf"], state["out"]
        long_part = F.length(part) > target
        overflow = F.length(buf) + F.length(part) + 1 > target
        flushed = F.concat(out, F.array(strip_begin(buf)))
        return F.struct(
            F.when(long_part, F.lit("")).when(overflow, part)
            .otherwise(strip_begin(F.concat(buf, F.lit(" "), part))).alias("buf"),
            F.when(long_part, F.concat(F.when(buf != "", flushed).otherwise(out), _cut(part, target)))
            .when(overflow, flushed).otherwise(out).alias("out"),
        )

    return F.aggregate(
        F.split(unit, SENTENCE_BREAK), empty, step,
        lambda s: F.concat(s["out"], F.array(strip_begin(s["buf"]))),
    )


def clause_units(text: Column, target: int = lx.CHUNK_TARGET_CHARS) -> Column:
    """Smallest pieces kept together: clauses, and packed sentences of long clauses."""
    clauses = _not_blank(F.transform(F.split(text, CLAUSE_START), strip_held))
    pieces = F.transform(
        clauses, lambda u: F.when(F.length(u) <= target, F.array(u)).otherwise(_repack(u, target))
    )
    return _not_blank(F.flatten(pieces))


def pack_units(units: Column, target: int = lx.CHUNK_TARGET_CHARS,
               overlap: int = lx.CHUNK_OVERLAP_CHARS, minimum: int = lx.CHUNK_MIN_CHARS) -> Column:
    """Chunks of one page as array<struct<text, source>>.

    ``source`` is the text before a short page tail was appended: identifiers come from it. Units have no blank at
    either end, as ``clause_units`` gives them, so a buffer can be blank at its beginning only; characters are counted
    only where the bytes may be too many.
    """
    empty = F.struct(
        F.lit("").alias("buf"), F.array().cast("array<struct<text:string,source:string>>").alias("out")
    )

    def chunk(text: Column) -> Column:
        return F.array(F.struct(text.alias("text"), text.alias("source")))

    def step(state: Column, unit: Column) -> Column:
        buf, out = state["buf"], state["out"]
        overflow = (buf != "") & (F.octet_length(buf) + F.octet_length(unit) + 1 > target) & (
            F.length(buf) + F.length(unit) + 1 > target)
        tail = F.when(F.length(buf) > overlap, F.substring(buf, -overlap, overlap)).otherwise(buf)
        gap = F.instr(tail, " ")
        carried = F.when(gap > 0, F.substring(tail, gap + 1, F.length(tail))).otherwise("")
        return F.when(overflow, F.struct(
            F.concat(carried, F.lit(" "), unit).alias("buf"), F.concat(out, chunk(strip_begin(buf))).alias("out"),
        )).otherwise(F.struct(strip_begin(F.concat(buf, F.lit(" "), unit)).alias("buf"), out.alias("out")))

    def finish(state: Column) -> Column:
        rest, out = strip_begin(state["buf"]), state["out"]
        last = F.element_at(out, -1)
        extended = F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1),
            F.array(F.struct(F.concat(last["text"], F.lit(" "), rest).alias("text"),
                             last["source"].alias("source"))),
        )
        return (
            F.when(F.length(rest) >= minimum, F.concat(out, chunk(rest)))
            .when((rest != "") & (F.size(out) > 0), extended)
            .otherwise(out)
        )

    return F.aggregate(units, empty, step, finish)


def chunk_pages(pages: DataFrame, keys: list[str], text: str = "text",
                status: str | None = "status") -> DataFrame:
    """Chunks of the usable pages: keys, page_number, pos, text and identifiers. No shuffle."""
    usable = pages if status is None else pages.where(F.col(status) == "ok")
    prepared = settled(usable.select(*keys, "page_number", normalise(F.col(text)).alias("_t"))).where(
        F.length("_t") >= lx.CHUNK_MIN_CHARS
    )
    units = settled(prepared.select(*keys, "page_number", clause_units(F.col("_t")).alias("_u")))
    packed = units.select(*keys, "page_number", F.posexplode(pack_units(F.col("_u"))).alias("pos", "c"))
    return packed.select(
        *keys, "page_number", "pos", F.col("c.text").alias("text"),
        standard_numbers(F.col("c.source")).alias("standard_ids"),
        gazette_numbers(F.col("c.source")).alias("gazette_ids"),
    )


def number_chunks(chunks: DataFrame, doc: str) -> DataFrame:
    """Ordinal over the document's pages, joined identifier strings and a stable chunk id.

    Only chunk counts per page travel to find a page's first ordinal, never the text.
    """
    sizes = chunks.groupBy(doc, "page_number").agg(F.count(F.lit(1)).alias("n"))
    first = running_sum(sizes, doc, "page_number", "n", "before")
    return chunks.join(first.select(doc, "page_number", "before"), [doc, "page_number"]).select(
        F.xxhash64(F.col(doc), F.col("before") + F.col("pos")).alias("chunk_id"),
        doc, "page_number", (F.col("before") + F.col("pos")).alias("ordinal"), "text",
        "standard_ids", "gazette_ids",
        joined(F.col("standard_ids")).alias("is_numbers"),
        joined(F.col("gazette_ids")).alias("gazette_refs"),
    )
