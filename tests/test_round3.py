"""Findings of round 3: each of these failed before its fix."""

from pyspark.sql import functions as F

from granthi.operators import overlap, retrieval
from granthi.plans.queries import REGISTRY


def test_streams_read_a_table_that_is_a_folder_of_files(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    embedded = REGISTRY["stream_embed"](spark, str(tmp_path))
    assert sorted(r.chunk_id for r in embedded.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    found = REGISTRY["stream_ingest"](spark, str(tmp_path)).select("sha256").distinct()
    assert found.count() > 0 and found.join(texts, "sha256", "left_anti").isEmpty()


def test_keyword_search_scores_equal_passages_and_questions_once(spark, monkeypatch):
    made = spark.range(600).select(
        F.col("id").alias("chunk_id"), F.concat(F.lit("red bolt "), F.when(F.col("id") % 3 == 0, "steel").otherwise("brass licence")).alias("text"),
        F.when(F.col("id") % 50 == 0, "IS 174").otherwise("").alias("is_numbers"), F.lit("").alias("gazette_refs"), F.lit("t").alias("title"))
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("steel bolt 900"), F.col("id"), F.when(
        F.col("id") % 2 == 0, " see IS 174").otherwise("")).alias("text"))
    counts, top_k = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, k, *more: counts.append(scored.count()) or top_k(scored, k, *more))
    hits = retrieval.keyword_search(made, asked, 5)
    assert counts and max(counts) <= 100
    whole = top_k(retrieval.bm25_scores(made, asked), 5)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert rows(hits) == rows(whole)


def test_verbatim_runs_make_rows_of_known_windows_only(spark, monkeypatch):
    other = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50)).cast("string")))).alias("text"))
    item = " ".join(f"Item{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, "too short")], "item_id bigint, text string")
    docs = other.unionByName(spark.createDataFrame([(500, f"before {item} after"), (501, None)], "doc_id bigint, text string"))
    assert overlap._known_shingles(docs, "doc_id", 26, items, "item_id").count() == 5
    runs = lambda: [tuple(r) for r in overlap.verbatim_runs(docs, items, "doc_id", "item_id").collect()]
    assert runs() == [(500, 1, 1, 0, 30)]
    monkeypatch.setattr(overlap, "LISTED_OPENINGS", 2)  # too many to list: all windows are joined
    assert runs() == [(500, 1, 1, 0, 30)]
