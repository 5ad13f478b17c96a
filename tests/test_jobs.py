import datetime as dt

import pytest
from pyspark.sql import functions as F

from granthi.operators import dedup, index, reports, webpages
from granthi.sources import corpus as src
from granthi.streaming import jobs


def test_paths_and_files(spark, tmp_path):
    for rel in ("_meta/log.txt", "cat/one.txt", "cat/sub/two__dup2__.txt"):
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(rel)
    rows = src.with_path_parts(src.read_files(spark, str(tmp_path))).orderBy("relpath").collect()
    assert [(r.relpath, r.category, r.subcategory, r.title) for r in rows] == [
        ("cat/one.txt", "cat", "", "one"), ("cat/sub/two__dup2__.txt", "cat", "sub", "two")]


def test_csv_and_golden_readers(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text("﻿filename,source_url\na.txt, u1 \n,u2\na.txt,u3\nb.txt,\n", encoding="utf-8")
    assert [tuple(r) for r in src.source_urls(src.read_provenance_csv(spark, str(log))).collect()] == [("a.txt", "u3")]
    golden = tmp_path / "g.jsonl"
    golden.write_text('// note\n\n{"question": "q", "expect_doc": "d"}\n')
    assert [tuple(r) for r in src.read_golden(spark, str(golden)).collect()] == [("q", "d", "", "en")]


def test_tariff_needs_every_column(spark):
    with pytest.raises(ValueError, match="Level"):
        src.load_tariff(spark.createDataFrame([("1",)], "HSN_CD string"))


def test_copies_of_a_hot_hash(spark):
    docs = spark.createDataFrame([(f"p{i:04d}", "same" if i % 3 else f"own {i}") for i in range(600)], "relpath string, text string")
    rows = dedup.resolve_copies(dedup.content_hashes(docs)).collect()
    assert len(rows) == 600 and sum(r.is_kept for r in rows) == 201
    assert {r.kept_path for r in rows if r.copies > 1} == {"p0001"}
    kept = dedup.keep_first_copies(docs)
    assert kept.count() == 201 and dedup.keep_first_copies(kept.drop("sha256")).count() == 201


def test_embedding_only_what_is_missing(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "")], "chunk_id bigint, text string")
    first = index.embed_missing(chunks, spark.createDataFrame([], jobs.VECTOR_SCHEMA))
    norms = {r.chunk_id: sum(x * x for x in r.embedding) for r in first.collect()}
    assert norms[1] == pytest.approx(1, abs=1e-6) and norms[3] == 0
    assert index.embed_missing(chunks, first).count() == 0
    custom = index.embed_missing(chunks, first.where("chunk_id = 1"), lambda texts: [[3.0, 4.0] for _ in texts], 2)
    assert {r.chunk_id: [round(x, 4) for x in r.embedding] for r in custom.collect()} == {2: [0.6, 0.8], 3: [0.6, 0.8]}


def test_html_blocks_and_chunks(spark):
    html = ("<html><title> T </title><script>x</script><h1>Head</h1><p>One <b>two</b><p>Three</p>"
            "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>" + "<p>" + "word " * 500 + "</p>" * 1 + "<p>" + "more " * 400 + "</p>")
    df = spark.createDataFrame([(1, html), (2, "%PDF-1.7 <p>x</p>")], "page_id bigint, html string")
    blocks = webpages.html_blocks(df)
    rows = blocks.orderBy("pos").collect()
    assert [(r.kind, r.text) for r in rows[:5]] == [
        ("title", "T"), ("heading", "Head"), ("paragraph", "One two"), ("paragraph", "Three"), ("table", "| A | B |\n| --- | --- |\n| 1 | 2 |")]
    chunks = webpages.block_chunks(blocks).orderBy("ordinal").collect()
    assert len(chunks) == 2 and chunks[0].header == "T > Head" and all("more more" in c.text or "word word" in c.text for c in chunks)
    assert chunks[1].text.startswith("word") and chunks[1].words < 600


def write_batches(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_stream_cap_equals_its_definition(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    batches = [[(base + dt.timedelta(hours=h), h) for h in range(5)],
               [(base + dt.timedelta(hours=h + 5), h + 5) for h in range(30)],
               [(base + dt.timedelta(days=9), 100), (base, 101)],
               [(base, 102), (base + dt.timedelta(days=9, hours=1), 103)]]
    source = tmp_path / "in"
    admitted = {}
    for rows in batches:
        write_batches(spark, source, [rows], "ts timestamp, id bigint")
        stream = spark.readStream.schema("ts timestamp, id bigint").parquet(str(source))
        jobs.admit_calls(stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp", limit=7).awaitTermination()
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        admitted[r.id] = r.admitted
    assert [admitted[i] for i in range(24)] == [i < 7 for i in range(24)]
    assert [admitted[i] for i in range(24, 35)] == [i < 31 for i in range(24, 35)]
    assert admitted[100] and admitted[103] and not admitted[102]


def test_stream_ingest_drops_copies_across_batches(spark, tmp_path):
    text = "The maker shall apply to the board for a licence under this rule and shall keep the records of it in order. " * 3
    source = tmp_path / "in"
    for rows in ([(1, text), (2, text)], [(3, text), (4, text + "More of the same rule is in the next order.")]):
        write_batches(spark, source, [rows], "doc_id bigint, text string")
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(source))
        jobs.ingest_documents(stream, f"{tmp_path}/chunks", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/chunks")
    assert got.select("sha256").distinct().count() == 2 and got.where("page_number = 1").count() == got.count()


def test_stream_embed_is_incremental(spark, tmp_path):
    source = tmp_path / "in"
    for rows in ([(1, "a b")], [(1, "a b"), (2, "c d")]):
        write_batches(spark, source, [rows], "chunk_id bigint, text string")
        stream = spark.readStream.schema("chunk_id bigint, text string").parquet(str(source))
        jobs.embed_chunks(stream, f"{tmp_path}/v", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.chunk_id for r in spark.read.parquet(f"{tmp_path}/v").collect()) == [1, 2]


def test_daily_usage_clamps_and_caps(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=i), i, -5 if i % 2 else 10, 1) for i in range(10)]
    calls = spark.createDataFrame(rows, "ts timestamp, id bigint, prompt_tokens bigint, completion_tokens bigint")
    day = reports.daily_usage(calls).first()
    assert (day.calls, day.prompt_tokens, day.completion_tokens, day.total_tokens) == (10, 50, 10, 60)
    assert reports.admit_calls(calls, 4).where("admitted").count() == 4
    assert reports.admit_calls(calls, 4, enabled=False).where("admitted").count() == 0
    assert reports.admission_threshold(calls, 40).first().remaining == 30


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "text", 0), ("b", 2, "text", 1)], "term string, chunk_id bigint, col string, pos int")
    docs = spark.createDataFrame([("x", "cat")], "relpath string, category string")
    for _ in range(2):
        src.write_index({"postings": df, "documents": docs}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 2
    assert spark.read.parquet(f"{tmp_path}/documents").where(F.col("category") == "cat").count() == 1
