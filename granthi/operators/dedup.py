"""Exact de-duplication with provenance, source URLs, document roll-up, incremental plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.session import broadcast_if_small, materialise

SALTS = 32


def content_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Path and SHA-256 of the bytes; the text itself goes no further."""
    return docs.select("relpath", F.sha2(F.col(text).cast("binary"), 256).alias("sha256"))


def resolve_copies(hashes: DataFrame) -> DataFrame:
    """Every path with the path that stands for its content and the number of copies.

    The smallest path wins. A hash may own a third of all paths, so paths are salted: the
    minimum is taken per (hash, salt) first, the few salt rows of a hash are combined, and
    the answer is joined back on (hash, salt). No task sees a whole group of copies, and the
    copies stay rows instead of one unbounded array.
    """
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("relpath"), F.lit(SALTS)))
    per_salt = salted.groupBy("sha256", "salt").agg(
        F.min("relpath").alias("first_path"), F.count(F.lit(1)).alias("n")
    )
    per_hash = per_salt.groupBy("sha256").agg(
        F.min("first_path").alias("kept_path"), F.sum("n").alias("copies")
    )
    resolved = per_salt.select("sha256", "salt").join(per_hash, "sha256")
    return salted.join(resolved, ["sha256", "salt"]).select(
        "relpath", "sha256", "kept_path", "copies",
        (F.col("relpath") == F.col("kept_path")).alias("is_kept"),
    )


def keep_first_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents without the later copies of the same content, with their hash.

    Only the paths of the later copies are written and joined away: read back with their true
    size, a small set is broadcast by the planner and the texts are not shuffled.
    """
    copies = resolve_copies(content_hashes(docs, text))
    later = materialise(copies.where(~F.col("is_kept")).select("relpath"), "later-copies")
    return docs.withColumn("sha256", F.sha2(F.col(text).cast("binary"), 256)).join(
        later, "relpath", "left_anti"
    )


def attach_source_urls(docs: DataFrame, urls: DataFrame) -> DataFrame:
    """Left join on the filename; an unknown source stays NULL."""
    return docs.join(broadcast_if_small(urls), "filename", "left")


def roll_up(docs: DataFrame, pages: DataFrame, key: str = "relpath") -> DataFrame:
    """Page counts by status per document; "empty" and failed pages are in none of the three.

    Pages are counted before the join, so document columns are never multiplied.
    """
    counts = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("status") == "ok").alias("pages_ok"),
        F.count_if(F.col("status") == "scanned").alias("pages_scanned"),
        F.count_if(F.col("status") == "mostly_corrupt").alias("pages_corrupt"),
    )
    zero = {c: 0 for c in ("page_count", "pages_ok", "pages_scanned", "pages_corrupt")}
    return docs.join(counts, key, "left").fillna(zero)


def plan_ingest(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each fetched row: failed, unchanged, skipped (repeated in the batch), created.

    ``batch`` carries the keys, ``row_id`` and ``error``. One row per (keys) is created, the
    one with the smallest ``row_id``. One hash may own a third of the batch, so rows are salted by id:
    minima are combined per salt, and the decision is joined back on keys and salt.
    """
    salted = batch.withColumn("__salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    per_salt = salted.where(F.col("error").isNull()).groupBy(*keys, "__salt").agg(F.min("row_id").alias("first_id"))
    firsts = per_salt.groupBy(*keys).agg(F.min("first_id").alias("first_id"))
    known = existing.select(*keys).distinct().withColumn("known", F.lit(True))
    decided = per_salt.select(*keys, "__salt").join(firsts.join(known, keys, "left"), keys)
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("known"), "unchanged")
        .when(F.col("row_id") == F.col("first_id"), "created")
        .otherwise("skipped")
    )
    return salted.join(decided, [*keys, "__salt"], "left").select(*batch.columns, status.alias("status"))


def ingest_summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def plan_rechunk(docs: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """Documents to chunk: never chunked, or chunked by another version of the rules."""
    current = done.where(F.col("version") == version).select("doc_id").distinct()
    older = done.where(F.col("version") != version).select("doc_id").distinct().withColumn("old", F.lit(True))
    return (
        docs.join(current, "doc_id", "left_anti").join(older, "doc_id", "left")
        .select("doc_id", F.when(F.col("old"), "regenerate").otherwise("create").alias("action"))
    )


def rechunked(chunks: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunk table after a version bump: untouched documents plus the regenerated ones."""
    return chunks.join(plan.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)
