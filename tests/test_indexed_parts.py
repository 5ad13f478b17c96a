from granthi import lexicons as lx
from granthi.operators import retrieval
from granthi.plans import derived as d


def test_parts_of_an_indexed_search_grow_with_the_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 100)
    passages, asked = d.passages(spark, sf), d.benchmark_queries(spark, sf)
    index = retrieval.keyword_index(passages)
    phrases = retrieval.query_terms(asked)
    parts = retrieval.score_partitions(index["corpus_stats"], phrases)
    assert parts == -(-passages.count() * asked.count() // 100) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    matches = retrieval.stored_matches(index["postings"], index["doc_len"], phrases, lx.PASSAGE_WEIGHTS, True, 23)
    assert matches.rdd.getNumPartitions() == 23


def test_hits_do_not_depend_on_the_parts(spark, sf, monkeypatch):
    passages, asked = d.passages(spark, sf), d.benchmark_queries(spark, sf)
    index = retrieval.keyword_index(passages)
    wanted = {(r.query_id, r.rank, r.chunk_id) for r in retrieval.keyword_search(passages, asked, 5).collect()}
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 200)
    assert wanted == {(r.query_id, r.rank, r.chunk_id) for r in retrieval.indexed_search(index, asked, 5).collect()}
