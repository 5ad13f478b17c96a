"""Answers over given passages by written indexes against the same answers by full scans."""

from pyspark.sql import functions as F

from granthi.operators import answers, bounded, pivots
from granthi.operators.index import hashed_vector
from granthi.plans import queries
from granthi.sources import segments

SUBJECTS = ["helmet", "cement", "kettle", "cable", "toy"]


def test_written_indexes_give_the_answers_of_the_scans(spark, tmp_path):
    passages = spark.createDataFrame(
        [(i, f"a/doc_{i}.txt", 1, f"doc {i}", "a", None,
          f"The {SUBJECTS[i % 5]} licence number {i} is granted. Each {SUBJECTS[i % 5]} needs a mark; fee {i % 7} applies.\n" + "filler words follow " * (i % 40),
          "", "", i) for i in range(120)],
        "chunk_id bigint, relpath string, page_number int, title string, category string, source_url string, text string, "
        "is_numbers string, gazette_refs string, doc_id bigint")
    vectors = passages.select("chunk_id", hashed_vector(F.col("text")).alias("embedding"))
    texts = ["Which licence does the helmet need?", "Which licence does the kettle need?", "Hello", "Who won the cricket match?",
             "Which licence covers zzzz qqqq?"]
    asked = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "query_id bigint, text string, expanded string").withColumn(
        "embedding", hashed_vector(F.col("text")))
    root = str(tmp_path / "index")
    segments.add(spark, root, passages)
    opened, cells = segments.open_index(spark, root), pivots.build(vectors, block_rows=10)
    ways = {"keyword": lambda q, k: bounded.bounded_search(opened, q, k), "dense": lambda q, k: pivots.search(cells, q, k)[0]}
    written = {r.query_id: r for r in answers.answer_batch(asked, passages, vectors, "hybrid", **ways).collect()}
    scanned = {r.query_id: r for r in answers.answer_batch(asked, passages, vectors, "hybrid").collect()}
    assert written == scanned and len(written) == 5
    assert written[0].grounded and "helmet" in written[0].answer and written[0].cited
    assert written[2].kind == "small_talk" and written[3].kind == "refusal"
    # Quotes are verbatim sentences of the passages.
    whole = " ".join(r.text for r in passages.collect())
    for line in written[1].answer.split("\n"):
        if line.startswith("    "):
            assert line.strip() in whole


def test_questions_and_vectors_are_written_before_they_are_read_again(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries.pivots, "build", lambda vectors: seen.setdefault("vectors", vectors))
    monkeypatch.setattr(queries.answers, "answer_batch", lambda asked, *_, **__: seen.setdefault("asked", asked))
    queries.document_answers(spark, sf)
    assert len(seen) == 2
    for df in seen.values():
        assert df.count() and "md5" not in df._jdf.queryExecution().optimizedPlan().toString()
