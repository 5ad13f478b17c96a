"""Linking tool calls with their results: joins by identifier, topological levels, checked arguments, canonical JSON.

All in DataFrame operations. Calls and results meet in a hash join on (conversation, call id); of several results
the earliest counts. Levels follow the dependencies: 0 without any, else one more than the highest of them. (level, place)
is a topological order. Calls on a cycle, or behind one, have no level. Arguments are parsed as variants, so that keys are sorted
at every depth when they are written, and checked field by field against a schema table.

Null or unparsable arguments are an error of the call, not of the job; its JSON then has null arguments.
Equal calls with the same id in a conversation are one; of different ones the earliest place (then the smaller text) counts. Null
conversation or call ids never link. Whatever ``link`` leaves out is a row of ``unlinked``: other calls with a used id, calls
without an id, later results of a call, results without a call. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthi.session import broadcast_if_small, materialise

KEY = ["conv_id", "call_id"]


CALL = ["place", "name", "arguments", "depends"]
# Weights double in each round on a cycle, whose calls get no level anyway.
MOST = 1 << 40


def _with_id(df: DataFrame) -> DataFrame:
    return df.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())


def _first(df: DataFrame, *columns: str) -> DataFrame:
    """The smallest row of each key: a minimum, so that a frequent key combines before the shuffle."""
    return df.groupBy(*KEY).agg(F.min(F.struct(*columns)).alias("first")).select(*KEY, *[F.col(f"first.{c}") for c in columns])


def kind_of(value: Column) -> Column:
    """JSON type of a variant: string, integer, number, boolean, array, object or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name.isin("BIGINT", "TINYINT", "SMALLINT", "INT"), "integer")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("null")
    )


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that can be ordered; ``depends`` lists call ids of the conversation.

    level(u) = max(base, level(v) + weight over the open edges u -> v). In each round calls without open edges are settled and
    folded into the bases of the calls that need them; an edge to a call with one open edge jumps over that call, which
    halves chains, so a chain of n calls takes about log n rounds. No round has more edges than the one before. It ends when
    nothing is settled: what is left then needs a cycle.
    """
    nodes = calls.select(*KEY, F.lit(0).cast("long").alias("base"))
    edges = (
        calls.select(*KEY, F.explode(F.array_distinct("depends")).alias("needs")).filter(F.col("needs").isNotNull())
        .join(calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")
        .select(*KEY, "needs", F.lit(1).cast("long").alias("weight"))
    )
    edges = materialise(edges, "needs")
    parts = []
    while True:
        done = materialise(
            nodes.join(edges.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.col("base").cast("int").alias("level")), "levels")
        parts.append(done)
        if edges.isEmpty() or done.isEmpty():
            break
        # What needs a settled call takes its level; all edges left lead to open calls.
        reached = done.select("conv_id", F.col("call_id").alias("needs"), "level")
        known = edges.join(reached, ["conv_id", "needs"])
        nodes = materialise(
            nodes.join(done, KEY, "left_anti").union(known.select(*KEY, F.col("weight") + F.col("level")))
            .groupBy(*KEY).agg(F.max("base").alias("base")), "nodes")
        edges = materialise(edges.join(reached, ["conv_id", "needs"], "left_anti"), "needs")
        single = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("open"), F.min("needs").alias("next"), F.max("weight").alias("step")).filter("open = 1")
        over = single.join(nodes, KEY).select("conv_id", F.col("call_id").alias("needs"), "next", "step", F.col("base").alias("under"))
        moved = materialise(edges.join(over, ["conv_id", "needs"], "left"), "moved")
        jumped = moved.filter(F.col("next").isNotNull())
        nodes = nodes.union(jumped.select(*KEY, F.least(F.col("under") + F.col("weight"), F.lit(MOST)))).groupBy(*KEY).agg(F.max("base").alias("base"))
        edges = moved.groupBy(*KEY, F.coalesce("next", "needs").alias("needs")).agg(
            F.max(F.least(F.col("weight") + F.coalesce("step", F.lit(0)), F.lit(MOST))).alias("weight"))
        edges = materialise(edges, "needs")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, place, name, level, has_result, valid, errors, json.

    ``calls``: conv_id, call_id, place, name, arguments (JSON text), depends (array of call ids).
    ``results``: conv_id, call_id, place, content.
    ``schemas``: name, field, kind, required; a name without rows is an unknown tool.
    """
    calls = materialise(_first(_with_id(calls), *CALL), "calls")
    answer = _with_id(results).groupBy(*KEY).agg(
        F.min(F.struct("place", "content")).alias("first"), F.count(F.lit(1)).alias("answers"))
    rules = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "kind", "required")).alias("rules"))

    given = F.expr("try_cast(try_parse_json(arguments) AS MAP<STRING, VARIANT>)")
    fields = F.transform(F.map_entries("given"), lambda e: F.struct(
        e["key"].alias("field"), kind_of(e["value"]).alias("kind")))
    matches = lambda have, want: (have == want) | ((have == "integer") & (want == "number"))
    wrong = F.transform("rules", lambda r: F.when(
        F.coalesce(F.exists("fields", lambda f: f["field"] == r["field"]), F.lit(False)),
        F.when(~matches(F.try_element_at(F.transform(F.filter("fields", lambda f: f["field"] == r["field"]),
                                                     lambda f: f["kind"]), F.lit(1)), r["kind"]),
               F.concat(F.lit("wrong type: "), r["field"])))
        .when(r["required"], F.concat(F.lit("missing: "), r["field"])))
    extra = F.transform("fields", lambda f: F.when(
        ~F.exists("rules", lambda r: r["field"] == f["field"]), F.concat(F.lit("not in schema: "), f["field"])))
    general = F.array(
        F.when(F.col("rules").isNull(), F.lit("unknown tool")),
        F.when(F.col("given").isNull(), F.lit("arguments are no object")),
        F.when(F.col("level").isNull(), F.lit("cycle")),
        F.when(F.coalesce("answers", F.lit(0)) > 1, F.lit("spare results")))
    errors = F.array_sort(F.array_compact(F.concat(
        general, F.coalesce(wrong, F.array().cast("array<string>")), F.coalesce(extra, F.array().cast("array<string>")))))
    record = F.struct(
        F.when(F.col("given").isNotNull(), F.expr("try_parse_json(arguments)")).alias("arguments"),
        F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.col("first")["content"].alias("result"))
    return (
        calls.join(levels(calls), KEY, "left").join(answer, KEY, "left").join(broadcast_if_small(rules), "name", "left")
        .withColumn("given", given).withColumn("fields", fields).withColumn("errors", errors)
        .select(*KEY, "place", "name", "level", F.col("first").isNotNull().alias("has_result"),
                (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"),
                F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that answer no call."""
    return results.join(calls.select(*KEY).distinct(), KEY, "left_anti")


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, name, has_result, status, json) of what ``link`` has no row for.

    status: ``repeated id`` (a different call with a used id; equal ones are one row), ``call without id``, ``spare result``
    (a later or equal result of a call, each copy a row), ``orphan result``. Whole rows are compared, so that the
    many rows of one id are spread.
    """
    def call_rows(df: DataFrame, status: str) -> DataFrame:
        return df.select(*KEY, "place", "name", F.lit(False).alias("has_result"), F.lit(status).alias("status"), F.to_json(
            F.struct("arguments", F.col("call_id").alias("id"), "name"), {"ignoreNullFields": "false"}).alias("json"))

    def result_rows(df: DataFrame, status: str) -> DataFrame:
        return df.select(*KEY, "place", F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("has_result"),
                         F.lit(status).alias("status"), F.to_json(
                             F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"}).alias("json"))

    known, given = calls.select(*KEY, *CALL), results.select(*KEY, "place", "content")
    used = _with_id(known)
    repeated = used.subtract(_first(used, *CALL))
    spare = _with_id(given).exceptAll(_first(_with_id(given), "place", "content")).join(used.select(*KEY).distinct(), KEY, "left_semi")
    no_id = known.filter(F.col("conv_id").isNull() | F.col("call_id").isNull())
    return (
        call_rows(repeated, "repeated id").unionByName(call_rows(no_id, "call without id"))
        .unionByName(result_rows(spare, "spare result")).unionByName(result_rows(orphans(known, given), "orphan result"))
    )
