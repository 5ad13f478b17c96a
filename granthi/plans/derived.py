"""Inputs of the registered queries, derived by Spark from the given tables.

The tables hold no standards, Devanagari or licences, so those shapes are produced row by row
from existing rows: the derived inputs grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.text import fix_mojibake, gazette_numbers, joined, standard_numbers, strip_ws
from granthi.operators.index import hashed_vectors
from granthi.session import spread
from granthi.sources.corpus import table, with_path_parts

LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI_LETTERS = "ाबचदेफगहिजकलमनोपखरसतुवटषयझ"
QUESTION_TEMPLATES = [
    "Which product certification scheme licence covers goods under IS {n}?",
    "Hello there",
    "What about foreign manufacturers?",
    "Who won the cricket world cup match?",
    "Thanks!",
    "तुम कौन है?",
    "How does a jeweller pay the hallmarking centre fee for gold purity?",
    "Does it expire?",
    "Please explain the weather forecast for tomorrow in detail",
    "क्या CRS registration की validity renewal जरूरी है?",
    "Tell me about the citizens charter complaint response timeline of the bureau",
]
TURN_OPENER = "Which licence covers this: "
ITEM_OPENER = "Which standard clause says: "
SUBJECTS = [query for *_, query in lx.STEPS]
LEVELS = ["Tariff Item", "Sub-heading", "Heading", "Chapter"]
LEAK_OPENERS = ["We need to look at this. ", "Okay, so ", "", "First, I ", "The answer: "]


def s(*parts) -> Column:
    """Concatenate columns and plain strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents with a path: relpath, doc_id, text and the parts of the path."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", s(F.col("source"), "/", F.col("lang"), "/doc_", F.col("doc_id"), ".txt").alias("relpath")
    )
    return with_path_parts(docs)


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """One passage per document, with the columns a chunk has."""
    text = F.col("text")
    return corpus(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), "relpath", F.lit(1).alias("page_number"), "title", "category",
        F.lit(None).cast("string").alias("source_url"), "text",
        joined(standard_numbers(text)).alias("is_numbers"), joined(gazette_numbers(text)).alias("gazette_refs"),
    )


def notice_text() -> Column:
    k = F.col("o_orderkey")
    return s(
        "Order ", k, " cites IS ", F.lit(300) + F.col("o_custkey"),
        F.when(k % 3 == 0, s(" : ", F.lit(1990) + k % 30)).otherwise(""),
        F.when(k % 5 == 0, s(" and S.O. ", k % 5000, "(E)")).otherwise(""),
        ". ", pick(SUBJECTS, k % len(SUBJECTS)), "; status ", F.col("o_orderstatus"), ". Clause ",
        k % 9 + 1, ".", k % 4 + 1, " applies.",
    )


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """One regulatory notice per order, as a passage with identifiers."""
    base = spread(table(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("page_number"),
        F.col("o_orderstatus").alias("category"), notice_text().alias("text"),
    )
    found = base.withColumn("standard_ids", standard_numbers(F.col("text"))).withColumn(
        "gazette_ids", gazette_numbers(F.col("text")))
    return found.select(
        "chunk_id", s("notices/notice_", F.col("chunk_id"), ".txt").alias("relpath"), "page_number",
        s("notice ", F.col("chunk_id")).alias("title"), "category",
        F.when(F.col("chunk_id") % 4 == 0, s("https://example.org/n/", F.col("chunk_id"))).alias("source_url"),
        "text", joined(F.col("standard_ids")).alias("is_numbers"),
        joined(F.col("gazette_ids")).alias("gazette_refs"), "standard_ids", "gazette_ids",
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items with the vector of the same id where one exists."""
    return benchmark_queries(spark, sf).join(
        vectors(spark, sf).withColumnRenamed("chunk_id", "query_id"), "query_id", "left")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations derived from customers: eight turns each, the fourth by the assistant."""
    k = F.col("c_custkey")
    text = F.replace(
        pick(QUESTION_TEMPLATES, k % len(QUESTION_TEMPLATES)), F.lit("{n}"),
        (F.lit(300) + F.col("c_nationkey")).cast("string"),
    )
    return table(spark, sf, "customer").select(
        k.alias("query_id"), F.floor(k / 8).alias("conv_id"), (k % 8).alias("turn"),
        F.when(k % 8 == 3, "assistant").otherwise("user").alias("role"), text.alias("text"),
    )


def document_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The user turns of conversations as they are and as a request, and benchmark texts: each distinct text is one question."""
    said = table(spark, sf, "conversations").where("role = 'user' AND text IS NOT NULL")
    asked = said.select("text").unionByName(said.select(s(TURN_OPENER, F.col("text")).alias("text"))).unionByName(
        table(spark, sf, "benchmark").where("text IS NOT NULL").select(s(ITEM_OPENER, F.col("text")).alias("text")))
    number = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 12), 16, 10).cast("bigint")
    questions = asked.distinct().select(number.alias("query_id"), "text", F.col("text").alias("expanded"))
    return hashed_vectors(questions, ["query_id", "text", "expanded"])


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return hashed_vectors(passages(spark, sf), ["chunk_id"])


def varied_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages, damaged in seven ways by id: scripts, glyph escapes, lost vowels."""
    t, k = F.col("text"), F.col("doc_id") % 7
    raw = (
        F.when(k == 1, F.translate(F.lower(t), LATIN_LETTERS, DEVANAGARI_LETTERS))
        .when(k == 2, F.replace(t, F.lit(" "), F.lit(" मानक ")))
        .when(k == 3, s("/uni0909 ", t))
        .when(k == 4, F.regexp_replace(t, "[aeiou]", ""))
        .when(k == 5, F.replace(t, F.lit("th"), F.lit("tH")))
        .when(k == 6, s(F.replace(t, F.lit(","), F.lit(" भारतीय मानक ब्यूरो का आदेश ")), "\n12 34\nab\n\n(cid:7) glyph"))
        .otherwise(t)
    )
    return table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_number"), raw.alias("raw"))


def paged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose sentences ending a line open a new page: several pages per document."""
    return corpus(spark, sf).withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\f")))


def clause_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Document pages with numbered clauses: every line break becomes a clause marker."""
    text = F.regexp_replace(F.regexp_replace("text", r"\n([A-Z])", "\n(a) $1"), r"\. ([OTE])", ".\n4.2 $1")
    return table(spark, sf, "documents").select(
        "doc_id", F.lit(1).alias("page_number"), text.alias("text"), F.lit("ok").alias("status"))


def marks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    value = (
        F.when(k % 8 == 0, s("CM/L-", F.lit(6300000000) + k))
        .when(k % 8 == 1, s("R-", F.lit(10000000) + k))
        .when(k % 8 == 2, s("IS ", F.lit(100) + k % 90000, ":2015"))
        .when(k % 8 == 3, F.upper(F.substring(F.md5(k.cast("string").cast("binary")), 1, 6)))
        .when(k % 8 == 4, s("IS", F.lit(1000) + k % 9000))
        .when(k % 8 == 5, F.col("c_name"))
        .when(k % 8 == 6, s(" cml", F.lit(123456) + k, " "))
        .otherwise(s("  ", F.col("c_mktsegment"), " "))
    )
    return table(spark, sf, "customer").select(k.alias("mark_id"), value.alias("value"))


def raw_tariff(spark: SparkSession, sf: str) -> DataFrame:
    """The code matrix as it arrives: untrimmed cells, blanks, broken dashes."""
    k = F.col("p_partkey")
    product = F.when(k % 10 == 3, F.replace("p_name", F.lit(" "), F.lit(" â€” "))).when(
        k % 50 == 7, F.lit("  ")).otherwise(s(" ", F.col("p_name"), " "))

    def text(prefix: str, every: int) -> Column:
        return F.when(k % every != 0, s(prefix, F.col("p_name")))

    cells = {
        "HSN_CD": s(" ", F.lit(1010) + k), "Level": pick(LEVELS, F.col("p_size") % 4),
        "Chapter": (k % 97).cast("string"), "Chapter_Title": F.col("p_type"), "Heading": F.col("p_brand"),
        "Product": product, "Import_Core_Docs": text("Invoice for ", 4), "Import_BIS_IS": text("Mark on ", 3),
        "Import_DGFT_Policy": F.when(k % 2 == 0, "Free").otherwise("Restricted"),
        "Import_Licence_Required": F.when(k % 6 == 0, "Yes").otherwise(""),
        "Import_Monitoring_System": F.lit(None).cast("string"), "Import_CoO": text("Origin of ", 5),
        "Import_Other_NOC": F.lit(""), "Export_Core_Docs": text("Packing list of ", 7),
        "Export_DGFT_Policy": F.lit("Free"), "Export_Other_NOC": F.when(k % 9 == 0, "NOC"),
        "Primary_Regulator": F.when(k % 3 == 0, "Regulator A"), "Verify_Against": F.when(k % 8 == 0, "Portal"),
    }
    return spread(table(spark, sf, "part")).select(k.alias("id"), *[c.cast("string").alias(n) for n, c in cells.items()])


def tariff(spark: SparkSession, sf: str) -> DataFrame:
    """Loaded matrix with the row id the lookups break ties on."""
    raw = raw_tariff(spark, sf)

    def cell(name: str) -> Column:
        value = fix_mojibake(strip_ws(F.col(name)))
        return F.when(value != "", value)

    return raw.select("id", *[cell(src).alias(dest) for src, dest in lx.TARIFF_COLUMNS]).where(
        F.col("hsn_cd").isNotNull() & F.col("product").isNotNull())


def tariff_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per customer: by padded code, by wrapped product name, or by a wrong code."""
    k = F.col("c_custkey")
    adjectives = ["red", "blue", "hot", "cold", "old", "new", "small", "large"]
    nouns = ["bolt", "plate", "widget", "rod", "ring", "anvil", "gear", "gizmo"]
    text = (
        F.when(k % 4 == 0, s("which documents for HSN 00", F.lit(1010) + k))
        .when(k % 4 == 1, s("I sell ", pick(adjectives, F.floor(k / 8) % 8), " ", pick(nouns, F.floor(k / 64) % 8),
                            ", what HSN code and whether BIS certification is required?"))
        .when(k % 4 == 2, s("tariff heading ", F.lit(90000000) + k, " for ", pick(nouns, F.floor(k / 8) % 8)))
        .otherwise(s("import of ", pick(adjectives, F.floor(k / 8) % 8), " goods"))
    )
    return table(spark, sf, "customer").select(k.alias("query_id"), text.alias("text"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """events as metered calls; some token counts come out negative."""
    return table(spark, sf, "events").select(
        "ts", F.col("event_id").alias("id"),
        (F.get_json_object("props", "$.k").cast("bigint") - 20).alias("prompt_tokens"),
        (F.floor("value").cast("bigint") - 5).alias("completion_tokens"),
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Routing answers per customer; some are missing, upper-cased or not an option."""
    k = F.col("c_custkey")
    industries = ["gold", "electronics", "electrical", "chemicals", "steel", "textiles", "footwear",
                  "glass", "other", "Gold", "toys"]
    pairs = [
        ("sector", F.when(k % 13 != 0, pick(["industrial", "consumer", "INDUSTRIAL"], k % 3))),
        ("industry", pick(industries, k % len(industries))),
        ("location", F.when(k % 7 != 0, pick(["india", "abroad"], F.floor(k / 3) % 2))),
        ("trade", pick(["domestic", "import", "export"], F.floor(k / 6) % 3)),
        ("need", F.when(k % 5 != 0, pick(["required", "verify", "complaint"], F.floor(k / 3) % 3))),
    ]
    return table(spark, sf, "customer").select(k.alias("case_id"), F.map_filter(
        F.create_map(*[x for key, value in pairs for x in (F.lit(key), value)]), lambda _, v: v.isNotNull()
    ).alias("answers"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s("CM/L-", F.lit(6300000000) + k).alias("number"), pick(["cml", "crs_r", "huid"], k % 3).alias("type"),
        F.col("s_name").alias("holder"), (F.col("s_acctbal") > 0).alias("active"))


def registry_asks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("query_id"), s("cm/l-", F.lit(6300000000) + k).alias("number"),
        F.when(k % 2 == 0, pick(["cml", "crs_r", "huid"], k % 3)).alias("type"))


SCHEME_KEYWORDS = [("ISI", "bolt"), ("ISI", "rod"), ("ISI", "Plate"), ("CRS", "widget"), ("CRS", "gizmo"),
                   ("HALLMARK", "ring"), ("FMCS", "large"), ("FMCS", "old"), ("ISI", "red")]
SCHEMES = [("ISI", True), ("CRS", True), ("HALLMARK", True), ("FMCS", False)]


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"),
                                           F.initcap("p_name").alias("description"))


def held_licences(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("product_id"), pick([n for n, _ in SCHEMES], k % 4).alias("scheme"),
        (F.col("p_size") % 3 != 0).alias("active"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """conversations with the debug record of an assistant turn and its feedback."""
    k = F.col("conv_id") * 16 + F.col("turn")
    intents = ["standard_lookup", "process_howto", "verification", "out_of_scope"]
    debug = F.to_json(F.struct(
        pick(intents, k % 4).alias("intent"), (k % 3).cast("int").alias("violations"),
        (k % 5 == 0).alias("forced_refusal"), (k % 97).cast("double").alias("latency_ms")))
    return table(spark, sf, "conversations").select(
        "conv_id", "role", F.when(F.col("role") == "assistant", debug).alias("debug"),
        F.when(k % 4 == 0, 1).when(k % 4 == 1, -1).when(k % 4 == 2, 0).alias("feedback"))


def supplied_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers made from assistant turns, with valid, foreign and padded markers."""
    k = F.col("conv_id") * 16 + F.col("turn")
    tail = F.when(k % 4 == 0, s(" [S", k % 9, "] and [S2]  ok [S2].")).when(
        k % 4 == 1, s(" [S0", F.lit(90) + k % 9, "] see  [S12].")).when(k % 4 == 2, s(" [S1].")).otherwise("")
    return table(spark, sf, "conversations").where("role = 'assistant'").select(
        k.alias("query_id"), s(pick(LEAK_OPENERS, k % 5), F.col("text"), tail).alias("answer"),
        (k % 5).alias("n_sources"))
