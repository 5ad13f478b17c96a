"""Line quality gate: script class, scores and verdict as expressions over the counts of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.line_counts import counts_of_lines
from granthi.functions.text import DEV, let, strip_ws

# Patterns of the gate.
UNMAPPED_GLYPH = r"/uni[0-9A-Fa-f]{4}|/g\d+|\(cid:\d+\)"


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _drop(when: Column, amount: Column) -> Column:
    return F.when(when, amount).otherwise(F.lit(0.0))


def _without(col: Column, pattern: str) -> Column:
    """How many characters a pattern covers, without a string per match."""
    return F.length(col) - F.length(F.regexp_replace(col, pattern, ""))


def _ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def devanagari_count(text: Column) -> Column:
    return F.when(_ascii(text), F.lit(0)).otherwise(_without(text, f"[{DEV}]+"))


def script_class(text: Column) -> Column:
    """neutral, latin, devanagari or mixed; a script needs three quarters of the letters."""
    return let(F.struct(devanagari_count(text).alias("dev"), _without(text, "[A-Za-z]+").alias("lat")),
               lambda m: script_of(m["dev"], m["lat"]))


def script_of(dev: Column, lat: Column) -> Column:
    """Script class from the numbers of Devanagari and Latin letters: three quarters are three times the other's."""
    return (
        F.when((dev == 0), F.when(lat > 0, "latin").otherwise("neutral"))
        .when(dev.cast("long") >= lat.cast("long") * 3, "devanagari")
        .when(lat.cast("long") >= dev.cast("long") * 3, "latin")
        .otherwise("mixed")
    )


def latin_score_of(m: Column) -> Column:
    """Score from the counts of a line; 1.0 where no Latin token exists.

    Every allowed short word has a vowel, so the vowelled tokens are those with one. Tokens
    without a vowel are judged from three characters on, Roman numerals excepted.
    """
    exotic = F.when(m["exotic"] > 0, m["exotic"] / m["chars"]).otherwise(0.0)
    novowel = F.when(m["judged"] > 0, m["novowel"] / m["judged"]).otherwise(0.0)
    score = (
        m["vowelled"] / m["n"]
        - _drop((m["n"] >= 6) & (m["stop"] == 0), F.lit(0.35))
        - _drop(exotic > 0.01, F.lit(0.30))
        - _drop(novowel > 0.15, F.least(F.lit(0.6), novowel * 1.6))
        - _drop(m["caps"] / m["n"] > 0.05, F.lit(0.35))
    )
    return F.when(m["n"] == 0, F.lit(1.0)).otherwise(_clamp(score))


def devanagari_score_of(m: Column) -> Column:
    """Score from the counts of a line; 1.0 where no Devanagari token exists.

    A combining mark without a base is the head of a mark run that follows no consonant.
    """
    n = m["dn"]
    runs = m["runs"] / F.greatest(n - 1, F.lit(1))
    fused, single, repeat = m["fused"] / n, m["singles"] / n, m["longest"] / n
    orphan = m["orphans"] / F.greatest(m["dev"], F.lit(1))
    score = (
        F.lit(1.0)
        - _drop(fused > 0.05, F.least(F.lit(0.6), fused * 3))
        - _drop(m["intrusions"] > 0, F.least(F.lit(0.6), 0.25 + 0.15 * m["intrusions"]))
        - _drop((n >= 8) & (single > 0.20), F.least(F.lit(0.6), single * 1.5))
        - _drop(runs > 0.12, F.least(F.lit(0.5), runs * 2))
        - _drop(orphan > 0.04, F.least(F.lit(0.5), orphan * 5))
        - _drop((n >= 8) & (repeat > 0.22), F.least(F.lit(0.5), repeat))
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(_clamp(score))


def assess_lines(lines: Column) -> Column:
    """Verdict of every line of an array: struct(stripped, script, score, verdict, reason).

    A page is judged inside its own row without a shuffle; the lines are counted by Arrow batches.
    """
    stripped = F.transform(lines, strip_ws)
    classed = F.zip_with(stripped, counts_of_lines(stripped), lambda line, m: F.struct(
        line.alias("s"), m.alias("m"),
        script_of(m["dev"], m["lat"]).alias("script"),
        (F.length(line) < lx.MIN_LINE_CHARS).alias("short"),
        ((line.contains("/") | line.contains("(cid:")) & line.rlike(UNMAPPED_GLYPH)).alias("unmapped"),
    ))
    judged = F.transform(classed, lambda x: F.struct(
        x.alias("x"), (~x["short"] & ~x["unmapped"] & (x["script"] != "neutral")).alias("known")))
    scored = F.transform(judged, lambda j: F.struct(
        j["x"].alias("x"),
        F.when(j["known"] & (j["x"]["script"] != "devanagari"), j["x"]["m"]["n"]).alias("ln"),
        F.when(j["known"] & (j["x"]["script"] != "latin"), j["x"]["m"]["dn"]).alias("dn"),
        F.when(j["known"] & (j["x"]["script"] != "devanagari"), latin_score_of(j["x"]["m"])).alias("ls"),
        F.when(j["known"] & (j["x"]["script"] != "latin"), devanagari_score_of(j["x"]["m"])).alias("ds"),
    ))
    return F.transform(scored, _verdict)


def _verdict(m: Column) -> Column:
    x, ls, ds = m["x"], m["ls"], m["ds"]
    score = F.coalesce(F.least(ls, ds), F.lit(0.0))
    latin_reason = (
        F.when(m["ln"] == 0, "no latin words to judge")
        .when(ls < lx.LATIN_REASON_SCORE, "latin gibberish").otherwise("ok")
    )
    dev_reason = (
        F.when(m["dn"] == 0, "no devanagari words to judge")
        .when(ds < lx.KEEP_SCORE, "devanagari corruption").otherwise("ok")
    )
    reason = (
        F.when(x["short"], "too short")
        .when(x["unmapped"], "unmapped glyph escapes")
        .when(x["script"] == "neutral", "no letters")
        .when(ds.isNull() | (ls <= ds), latin_reason)
        .otherwise(dev_reason)
    )
    return F.struct(
        x["s"].alias("stripped"),
        F.when(x["short"], "neutral").otherwise(x["script"]).alias("script"),
        score.alias("score"),
        F.when(score >= lx.KEEP_SCORE, "keep").otherwise("reject").alias("verdict"),
        reason.alias("reason"),
    )


def assess_line(line: Column) -> Column:
    """Verdict of a single line."""
    return F.element_at(assess_lines(F.array(line)), 1)
