"""Decision-table routing over cases (case_id, answers map). Every step is map-only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.operators.retrieval import search


def _answer(key: str) -> Column:
    return F.lower(F.coalesce(F.col("answers")[key], F.lit("")))


def _questions() -> Column:
    """All questions with whether they show and what the case answered."""
    def one(key: str, position: int, allowed: list[str], governed) -> Column:
        shown = F.lit(True) if governed is None else _answer(governed[0]) == governed[1]
        given = _answer(key)
        return F.struct(
            F.lit(key).alias("key"), F.lit(position).alias("position"), shown.alias("shown"),
            given.alias("given"), given.isin(allowed).alias("allowed"),
        )

    return F.array(*[one(*q) for q in lx.QUESTIONS])


def visible_questions(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode(F.filter(_questions(), lambda q: q["shown"])).alias("q")).select(
        "case_id", F.col("q.key").alias("key"), F.col("q.position").alias("position")
    )


def validate(cases: DataFrame) -> DataFrame:
    """Missing and disallowed keys of each case; a case is never completed by defaults."""
    shown = F.filter(_questions(), lambda q: q["shown"])

    def keys(test) -> Column:
        return F.transform(F.filter(shown, test), lambda q: q["key"])

    missing = keys(lambda q: q["given"] == "")
    disallowed = keys(lambda q: (q["given"] != "") & ~q["allowed"])
    return cases.select("case_id", "answers", missing.alias("missing"), disallowed.alias("disallowed")).select(
        "case_id", "answers", "missing", "disallowed",
        ((F.size("missing") == 0) & (F.size("disallowed") == 0)).alias("valid"),
    )


def next_question(cases: DataFrame) -> DataFrame:
    """First visible question without an answer; NULL means done."""
    open_ones = F.filter(_questions(), lambda q: q["shown"] & (q["given"] == ""))
    return cases.select("case_id", F.get(open_ones, F.lit(0))["key"].alias("next_key"))


def route(cases: DataFrame) -> DataFrame:
    """Scheme of each valid case: the first rule of the table whose filled cells all match."""
    keys = ("sector", "industry", "location", "trade", "need")

    def matches(cells) -> Column:
        return reduce(lambda a, b: a & b, [_answer(k) == v for k, v in zip(keys, cells) if v is not None])

    rule = F.coalesce(*[
        F.when(matches(cells), F.struct(F.lit(code).alias("code"), F.lit(steps).alias("steps")))
        for _, *cells, code, steps in lx.ROUTES
    ])
    names = F.create_map(*[F.lit(x) for pair in lx.SCHEME_NAMES.items() for x in pair])
    return (
        validate(cases).where("valid").withColumn("r", rule)
        .select(
            "case_id", _answer("sector").alias("sector"), F.col("r.code").alias("scheme_code"),
            names[F.col("r.code")].alias("scheme"), F.col("r.steps").alias("step_list"),
            F.when(F.col("r.code") == "EXPORT", lx.EXPORT_CAVEAT).otherwise(lx.ROUTE_CAVEAT).alias("caveat"),
        )
    )


def step_evidence(spark, passages: DataFrame, vectors: DataFrame | None = None,
                  mode: str = "keyword", top: int = 3) -> DataFrame:
    """Citations per step: each distinct step query is searched once for all cases."""
    steps = spark.createDataFrame(lx.STEPS, "step_list string, position int, title string, text string")
    queries = steps.select("text").distinct().select(F.xxhash64("text").alias("query_id"), "text")
    if vectors is not None:
        from granthi.operators.index import hashed_vector
        queries = queries.withColumn("embedding", hashed_vector(F.col("text")))
    hits = search(passages, vectors, queries, mode, top)
    # At most top passages per step query: the collected list is bounded.
    shown = passages.select("chunk_id", "relpath", "page_number", F.substring(
        "text", 1, lx.STEP_PASSAGE_CHARS).alias("passage"))
    cited = shown.join(F.broadcast(hits), "chunk_id").groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", "relpath", "page_number", "passage"))).alias("citations"))
    return steps.withColumn("query_id", F.xxhash64("text")).join(cited, "query_id", "left").select(
        "step_list", "position", "title",
        F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)).alias("citations"),
        F.when(F.col("citations").isNotNull(), lx.STEP_COVERED).otherwise(lx.STEP_NOT_COVERED).alias("detail"),
    )


def pathways(routed: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per case and step. The evidence holds one row per step of the fixed table."""
    return routed.join(F.broadcast(evidence), "step_list").select(
        "case_id", "scheme_code", "position", "title", "detail", "citations"
    )


