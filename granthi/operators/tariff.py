"""Code table lookups: by code, by product, cascade and compliance cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.operators.retrieval import keyword_search

# Trigger words of a tariff question and a code inside a text.
TRIGGER = r"(?iU)\bhsn\b|\bhs\s*code\b|\btariff\s*(?:code|heading|item)\b"
CODE = r"(?U)\b\d{2,8}\b"
WRAPPER = r"(?iU)\b(?:" + "|".join(lx.TARIFF_WRAPPER_WORDS) + r")\b"


# Row ids stay below this, about 10^15.
LEVEL_STEP = 1 << 50


def mentions_tariff(text: Column) -> Column:
    return F.coalesce(text.rlike(TRIGGER), F.lit(False))


def extract_code(text: Column) -> Column:
    """First standalone number of 2 to 8 digits, NULL without one."""
    found = F.regexp_extract(text, CODE, 0)
    return F.when(found != "", found)


def without_trigger(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), TRIGGER, " ")


def product_query(text: Column) -> Column:
    """The question without trigger and wrapper words: about the product name."""
    return F.regexp_replace(without_trigger(text), WRAPPER, " ")


def code_key(text: Column) -> Column:
    """Digits only, leading zeros gone; NULL without digits."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", ""))


def by_code(lookups: DataFrame, tariff: DataFrame) -> DataFrame:
    """At most one row per lookup: (query_id, text) joined to the row with exactly this code."""
    keyed = lookups.withColumn("hsn_cd", code_key(F.col("text"))).where(F.col("hsn_cd").isNotNull())
    # One row per code before the join, so a repeated code cannot multiply lookups.
    first = tariff.groupBy("hsn_cd").agg(F.min_by(F.struct(*tariff.columns), "id").alias("r"))
    return keyed.join(first, "hsn_cd").select("query_id", "r.*")


def by_product(lookups: DataFrame, tariff: DataFrame, k: int = 5) -> DataFrame:
    """BM25 over product, heading and chapter title; ties prefer the more specific level."""
    priority = F.lit(3)
    for name, value in lx.LEVEL_PRIORITY.items():
        priority = F.when(F.col("level") == name, F.lit(value)).otherwise(priority)
    # The chunk id carries the level above the row id, so ties need no join with the levels.
    passages = tariff.select(
        (priority.cast("bigint") * LEVEL_STEP + F.col("id")).alias("chunk_id"), *lx.TARIFF_WEIGHTS)
    return keyword_search(passages, lookups, k, lx.TARIFF_WEIGHTS).select(
        "query_id", (F.col("chunk_id") % LEVEL_STEP).alias("id"), "rank", "score")


def lookup(lookups: DataFrame, tariff: DataFrame, k: int = 5) -> DataFrame:
    """Code first where the text has a digit, else product search on the cleaned text.

    Every lookup keeps at least one row; ``found`` tells whether anything matched.
    """
    coded = by_code(lookups.where(F.col("text").rlike(r"\d")), tariff).select(
        "query_id", "id", F.lit(1).alias("rank"), F.lit("code").alias("matched_by")
    )
    rest = lookups.join(coded.select("query_id"), "query_id", "left_anti").select(
        "query_id", product_query(F.col("text")).alias("text")
    )
    named = by_product(rest, tariff, k).select("query_id", "id", "rank", F.lit("product").alias("matched_by"))
    return lookups.select("query_id").join(coded.unionByName(named), "query_id", "left").select(
        "query_id", "id", "rank", F.coalesce("matched_by", F.lit("product")).alias("matched_by"),
        F.col("id").isNotNull().alias("found"),
    )


def _lines(fields: list[tuple[str, str, str]], position: int) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(name), F.lit("")) != "",
               F.concat(F.lit(f"  - {labels[position]}: "), F.col(name)))
        for name, *labels in fields
    ]))


def card(language: str) -> Column:
    """Plain-language card of one row; empty fields are left out."""
    says = lx.CARD_CAPTIONS[language]
    position = 1 if language == "hi" else 0

    def optional(name: str, *before: Column) -> Column:
        filled = F.coalesce(F.col(name), F.lit("")) != ""
        return F.when(filled, F.array(*before[:-1], F.concat(before[-1], F.col(name)))).otherwise(
            F.array().cast("array<string>"))

    pieces = F.concat(
        F.array(F.concat(F.lit("HSN "), F.col("hsn_cd"), F.lit(" — "), F.col("product"))),
        optional("chapter_title", F.lit(says["chapter"])),
        F.array(F.lit(""), F.lit(says["import"])), _lines(lx.IMPORT_FIELDS, position),
        F.array(F.lit(""), F.lit(says["export"])), _lines(lx.EXPORT_FIELDS, position),
        optional("primary_regulator", F.lit(""), F.lit(says["regulator"])),
        optional("verify_against", F.lit(says["verify"])),
        F.array(F.lit("")),
    )
    return F.array_join(pieces, "\n")


def cards(found: DataFrame, tariff: DataFrame, language: str = "en") -> DataFrame:
    """One answer text per lookup: its rows' cards in rank order, then the note.

    A lookup has at most k rows, so the collected list is bounded.
    """
    rows = tariff.select("id", card(language).alias("card"))
    joined = found.join(rows, "id", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "card"))), lambda r: r["card"])
    return joined.groupBy("query_id").agg(F.max("found").alias("found"), listed.alias("c")).select(
        "query_id", F.when(
            F.col("found"),
            F.concat(F.array_join("c", "\n"), F.lit("\n" + lx.CARD_NOTE[language])),
        ).otherwise(lx.CARD_EMPTY[language]).alias("answer"),
    )


