"""Identifier decoding and registry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.text import standard_numbers, strip_ws
from granthi.session import broadcast_if_small

# The shapes of the marks, tested in this order.
LICENCE = r"(?iU)^\s*CM\s*/?\s*L\s*[-–/]?\s*(\d{6,12})\s*\z"
REGISTRATION = r"(?iU)^\s*R\s*[-–]\s*(\d{6,12})\s*\z"
STANDARD = (
    r"(?iU)^\s*IS\s*(?:/\s*(?:IEC|ISO|EN))?\s*:?\s*\d{2,5}"
    r"(?:\s*[-–]\s*\d{1,2})?(?:\s*\(?\s*Part\s*\d+\s*\)?)?(?:\s*[:\-]\s*(?:19|20)\d{2})?\s*\z"
)
HALLMARK = r"(?i)^[A-Z0-9]{6}\z"


def mark_kind(value: Column) -> Column:
    """licence, crs, standard, hallmark or unknown; a hallmark code needs a digit."""
    raw = strip_ws(F.coalesce(value, F.lit("")))
    return (
        F.when(raw == "", "unknown")
        .when(raw.rlike(LICENCE), "licence")
        .when(raw.rlike(REGISTRATION), "crs")
        .when(raw.rlike(STANDARD), "standard")
        .when(raw.rlike(HALLMARK) & raw.rlike(r"\d"), "hallmark")
        .otherwise("unknown")
    )


def decode(marks: DataFrame, value: str = "value") -> DataFrame:
    """Kind, recognition, label, explanation, note on the shape, caution, hint and warnings of each mark."""
    spark = marks.sparkSession
    kinds = spark.createDataFrame(
        lx.MARK_KINDS, "kind string, label string, explanation string, caution string, verify_at string, hint string"
    )
    digits = F.length(F.regexp_extract(strip_ws(F.col(value)), LICENCE, 1))
    warning = F.when(
        (F.col("kind") == "licence") & (digits != 10),
        F.array(F.concat(F.lit("expected 10 digits, found "), digits.cast("string"))),
    ).otherwise(F.array().cast("array<string>"))
    note = F.when(F.col("kind") == "licence", F.concat(F.lit("Shape of a licence with "), digits.cast("string"), F.lit(" digits."))).when(
        F.col("kind") != "unknown", F.concat(F.lit("Shape of a "), F.lower("label"), F.lit(".")))
    return (
        marks.withColumn("kind", mark_kind(F.col(value)))
        .join(F.broadcast(kinds), "kind", "left")
        .select(
            *marks.columns, "kind", (F.col("kind") != "unknown").alias("recognised"), "label",
            "explanation", note.alias("format_note"), "caution", "verify_at",
            F.coalesce("hint", strip_ws(F.coalesce(F.col(value), F.lit("")))).alias("search_hint"),
            warning.alias("warnings"),
        )
    )


def kind_counts(marks: DataFrame, value: str = "value") -> DataFrame:
    return marks.groupBy(mark_kind(F.col(value)).alias("kind")).agg(F.count(F.lit(1)).alias("marks"))


# Identifier shapes inside a question; only the first two lead to chunks.
CLAUSE_IN_TEXT = r"(?iU)\bclause\s+\d+(?:\.\d+)*"
LICENCE_IN_TEXT = r"(?iU)\bCM\s*/?\s*L\s*[-–/]?\s*\d{6,12}\b"
REGISTRATION_IN_TEXT = r"(?iU)\bR\s*[-–]\s*\d{6,12}\b"
HALLMARK_IN_TEXT = r"(?U)\b(?=[A-Z0-9]{0,5}\d)(?=[A-Z0-9]{0,5}[A-Z])[A-Z0-9]{6}\b"


def typed_identifiers(text: Column) -> Column:
    """array<struct<kind, value>> of every identifier in a question."""
    def typed(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def found(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.upper)

    return F.concat(
        typed("standard", standard_numbers(text)),
        typed("clause", found(CLAUSE_IN_TEXT)),
        typed("licence", found(LICENCE_IN_TEXT)),
        typed("crs", found(REGISTRATION_IN_TEXT)),
        typed("hallmark", found(HALLMARK_IN_TEXT)),
    )


def has_licence_identifier(text: Column) -> Column:
    return F.exists(typed_identifiers(text), lambda i: i["kind"].isin("licence", "crs", "hallmark"))


def verify_licences(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Case-insensitive match of number and, where given, type. Not a live register.

    ``asked`` is (query_id, number, type), ``registry`` (number, type, holder, active). The
    registry is reduced to one row per number and type first.
    """
    reg = registry.groupBy(F.upper("number").alias("key"), F.col("type").alias("reg_type")).agg(
        F.min("holder").alias("holder"), F.max("active").alias("active")
    )
    wanted = asked.withColumn("key", F.upper("number"))
    match = (wanted["key"] == reg["key"]) & (wanted["type"].isNull() | (wanted["type"] == reg["reg_type"]))
    matched = wanted.join(reg, match, "inner").groupBy("query_id").agg(
        F.min_by(F.struct("reg_type", "holder", "active"), "reg_type").alias("m")
    )
    return asked.join(matched, "query_id", "left").select(
        "query_id", "number", F.col("m").isNotNull().alias("found"),
        F.col("m.reg_type").alias("matched_type"), F.col("m.holder").alias("holder"),
        F.coalesce("m.active", F.lit(False)).alias("active"),
    )


RUN_LENGTHS = (16, 8, 4, 2, 1)


def match_schemes(products: DataFrame, keywords: DataFrame) -> DataFrame:
    """Schemes whose keyword occurs in the description: a semi-join shape, one row per pair.

    ``keywords`` is (scheme, keyword) of any size; empty keywords match nothing. Keywords fall into classes of 1, 2, 4,
    8 and 16 characters, the greatest not above their length. Runs of characters of the texts, of each length that
    a class has, meet the beginnings of its keywords in an equi-join, and only those pairs are compared: a
    keyword of one letter costs its own matches and leaves the long ones selective. Shared descriptions are matched once each.
    """
    rules = keywords.select("scheme", F.lower("keyword").alias("keyword")).filter(F.length("keyword") > 0).distinct()
    size = F.length("keyword")
    rules = rules.withColumn("n", F.coalesce(*[F.when(size >= n, F.lit(n)) for n in RUN_LENGTHS]))
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())
    distinct = products.select(F.lower("description").alias("text")).distinct()

    def runs(n: int) -> Column:
        starts = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(n))))

    found = F.concat(F.array().cast("array<string>"), *[runs(n) for n in lengths])
    hits = (
        distinct.select("text", F.explode(found).alias("run"))
        .join(rules.withColumn("run", F.substring("keyword", F.lit(1), F.col("n"))), "run")
        .filter(F.contains("text", "keyword")).select("text", "scheme").distinct()
    )
    return products.join(hits, F.lower("description") == F.col("text")).select("product_id", "scheme")


def compliance_gaps(matched: DataFrame, schemes: DataFrame, held: DataFrame) -> DataFrame:
    """Matched schemes that no active held licence covers, with the mandatory flag.

    ``held`` is (product_id, scheme, active).
    """
    covered = held.where(F.col("active")).select("product_id", "scheme").distinct()
    return matched.join(covered, ["product_id", "scheme"], "left_anti").join(
        broadcast_if_small(schemes), "scheme"
    ).select("product_id", "scheme", F.when(F.col("mandatory"), "mandatory").otherwise("voluntary").alias("gap"))

