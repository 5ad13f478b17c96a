"""Reports, retrieval evaluation, usage metering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.session import broadcast_if_small, materialise


def category_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, pages, scanned, corrupt and chunks per category.

    Chunks are counted per document, documents summed per category: nothing is multiplied.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(per_doc, "doc_id", "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("page_count").alias("pages"),
        F.sum("pages_scanned").alias("scanned"), F.sum("pages_corrupt").alias("corrupt"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
    )


def corpus_totals(docs: DataFrame, chunks: DataFrame, copies: DataFrame) -> DataFrame:
    """One row of totals over kept documents, chunks and skipped copies."""
    totals = docs.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("page_count").alias("pages"),
        F.sum("pages_ok").alias("pages_ok"), F.sum("pages_scanned").alias("pages_scanned"),
        F.sum("pages_corrupt").alias("pages_corrupt"), F.count("error").alias("failed_documents"),
    )
    skipped = copies.agg(F.count_if(~F.col("is_kept")).alias("duplicate_files_skipped"))
    n_chunks = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    # Three one-row tables side by side.
    return totals.crossJoin(F.broadcast(skipped)).crossJoin(F.broadcast(n_chunks)).withColumn(
        "usable_page_pct", F.round(100.0 * F.col("pages_ok") / F.col("pages"), 6)
    )


def index_health(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of documents, chunks and vectors; semantic search needs at least one vector."""
    counts = [
        docs.agg(F.count(F.lit(1)).alias("documents")),
        chunks.agg(F.count(F.lit(1)).alias("chunks")),
        vectors.agg(F.count(F.lit(1)).alias("embedded")),
    ]
    joined = counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))
    return joined.withColumn("semantic_available", F.col("embedded") > 0)


def top_scanned(docs: DataFrame, k: int = 10) -> DataFrame:
    return docs.where(F.col("pages_scanned") > 0).select("relpath", "pages_scanned").orderBy(
        F.col("pages_scanned").desc(), "relpath"
    ).limit(k)


def unreadable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("error").isNotNull()).select("relpath", "error")


# --- evaluation ------------------------------------------------------------------


def expected_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Rank of the first hit whose path contains the expected text, per case and mode.

    ``cases`` is (query_id, mode, expect_doc): every case appears once per mode, so a mode
    without vectors still counts its misses. ``hits`` is (query_id, mode, rank, relpath).
    """
    right = F.lower("relpath").contains(F.lower("expect_doc"))
    found = hits.join(cases, ["query_id", "mode"]).where(right).groupBy("query_id", "mode").agg(
        F.min("rank").alias("rank")
    )
    return cases.join(found, ["query_id", "mode"], "left")


def retrieval_scores(ranks: DataFrame) -> DataFrame:
    """hit@k, hit@1 and MRR per mode over all cases."""
    return ranks.groupBy("mode").agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.col("rank").isNotNull().cast("int")).alias("hit_at_k"),
        F.avg(F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0))).alias("hit_at_1"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def misses(ranks: DataFrame, mode: str = "hybrid") -> DataFrame:
    return ranks.where((F.col("mode") == mode) & F.col("rank").isNull()).select("query_id", "expect_doc")


def recall_at_k(golden: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Recall@k and MRR where a hit is right if it carries one of the expected identifiers.

    ``golden`` is (query_id, expected array), ``hits`` (query_id, rank, standard_ids).
    """
    good = hits.where(F.col("rank") <= k).join(golden, "query_id").where(
        F.arrays_overlap("expected", "standard_ids")
    ).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return golden.join(good, "query_id", "left").agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.col("rank").isNotNull().cast("int")).alias("recall_at_k"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def _share(hit: Column, among: Column) -> Column:
    return F.try_divide(F.count_if(hit & among), F.count_if(among))


def answer_metrics(predictions: DataFrame, golden: DataFrame) -> DataFrame:
    """Intent accuracy, citation precision, refusal accuracy, false refusals, mean latency.

    ``predictions`` is (query_id, intent, n_cited, n_invalid, forced_refusal, latency_ms).
    """
    refuses = F.coalesce("expects_refusal", F.lit(False))
    joined = golden.join(predictions, "query_id")
    return joined.agg(
        F.count(F.lit(1)).alias("questions"),
        F.avg((F.col("intent") == F.col("expected_intent")).cast("int")).alias("intent_accuracy"),
        _share((F.col("n_cited") > 0) & (F.col("n_invalid") == 0), F.col("expects_citation")).alias("citation_precision"),
        _share(F.col("forced_refusal"), refuses).alias("forced_refusal_accuracy"),
        _share(F.col("forced_refusal"), ~refuses).alias("false_refusal_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    )


DEBUG_SCHEMA = "intent string, violations int, forced_refusal boolean, latency_ms double"


def conversation_analytics(messages: DataFrame) -> DataFrame:
    """Dashboard figures over (conv_id, role, debug json, feedback)."""
    m = messages.withColumn("d", F.from_json("debug", DEBUG_SCHEMA))
    answered = F.col("role") == "assistant"
    return m.agg(
        F.count_distinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.when(answered, F.col("d.violations"))), F.lit(0)).alias("guardrail_violations"),
        _share(F.coalesce(F.col("d.forced_refusal"), F.lit(False)), answered).alias("forced_refusal_rate"),
        F.avg(F.when(answered, F.col("d.latency_ms"))).alias("mean_latency_ms"),
        F.count_if(answered & (F.col("feedback") == 1)).alias("feedback_up"),
        F.count_if(answered & (F.col("feedback") == -1)).alias("feedback_down"),
        _share(F.coalesce("feedback", F.lit(0)) != 0, answered).alias("feedback_response_rate"),
    )


def intent_distribution(messages: DataFrame) -> DataFrame:
    return (
        messages.where(F.col("role") == "assistant")
        .groupBy(F.coalesce(F.from_json("debug", DEBUG_SCHEMA)["intent"], F.lit("unknown")).alias("intent"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def latest_feedback(ratings: DataFrame) -> DataFrame:
    """The last rating per message; later rows overwrite earlier ones."""
    return ratings.groupBy("message_id").agg(F.max_by("rating", F.struct("ts", "event_id")).alias("rating"))


# --- metering --------------------------------------------------------------------


def daily_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens per day; negative token counts are zero."""
    prompt = F.sum(F.greatest(F.col("prompt_tokens"), F.lit(0)))
    completion = F.sum(F.greatest(F.col("completion_tokens"), F.lit(0)))
    return calls.groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("calls"), prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"),
    )


def admission_threshold(calls: DataFrame, limit: int) -> DataFrame:
    """Per day the last admitted (ts, id) and how many calls are left.

    Only the first ``limit`` calls of a day survive the rank filter, which runs before the
    shuffle; a day that holds a third of all calls is cut on every task.
    """
    order = Window.partitionBy("date").orderBy("ts", "id")
    first = (
        calls.select(F.to_date("ts").alias("date"), "ts", "id")
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    )
    return first.groupBy("date").agg(
        F.max(F.struct("ts", "id")).alias("last"), F.count(F.lit(1)).alias("admitted_calls")
    ).withColumn("remaining", F.greatest(F.lit(limit) - F.col("admitted_calls"), F.lit(0)))


def admit_calls(calls: DataFrame, limit: int = lx.DAILY_CALL_LIMIT, enabled: bool = True) -> DataFrame:
    """Whether each call is admitted: the n-th call of a day is, while n is within the limit."""
    if not enabled or limit <= 0:
        return calls.select(F.to_date("ts").alias("date"), "ts", "id", F.lit(False).alias("admitted"))
    # One row per day, measured before it is sent to the calls: they are not gathered by day.
    last = broadcast_if_small(materialise(admission_threshold(calls, limit).select("date", "last"), "thresholds"))
    return calls.withColumn("date", F.to_date("ts")).join(last, "date").select(
        "date", "ts", "id", (F.struct("ts", "id") <= F.col("last")).alias("admitted")
    )
