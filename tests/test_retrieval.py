import sqlite3

import numpy as np
import pytest

from granthi import lexicons as lx
from granthi.operators import retrieval

PASSAGES = [
    (1, "grant of licence for the Standard Mark, see IS 17440 : 2020", "IS 17440 : 2020", "", "licence guide", 3),
    (2, "fee for hallmarking gold jewellery and the licence fee fee fee", "", "S.O. 12(E)", "hallmark fee", 1),
    (3, "toys order with IS 174 and the quality control order", "IS 174", "", "toys", 2),
    (4, "licence licence licence licence cancellation rules", "", "", "rules", 9),
    (5, "don't apply; café rules of the board", "", "", "café", 4),
    (6, "nothing of interest here at all", "", "", "other", 5),
]
QUERIES = [(1, "licence fee for IS 17440 : 2020?"), (2, "café don't apply"), (3, '"* OR (rules) NEAR : -x'), (4, "what is the"),
           (5, "licence licence fee"), (6, "'; DROP TABLE chunks; --"), (7, "   "), (8, "S.O. 12(E) order")]


def passages(spark):
    return spark.createDataFrame(PASSAGES, "chunk_id bigint, text string, is_numbers string, gazette_refs string, title string, page_number int")


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id bigint, text string")


def test_bm25_equals_a_full_text_engine(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(text, is_numbers, gazette_refs, title, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    for p in PASSAGES:
        con.execute("INSERT INTO f(rowid, text, is_numbers, gazette_refs, title) VALUES (?,?,?,?,?)", p[:5])
    phrases = {}
    for r in retrieval.query_terms(queries(spark)).collect():
        phrases.setdefault(r.query_id, []).extend([r.phrase] * r.times)
    got = {}
    for r in retrieval.keyword_search(passages(spark), queries(spark), 10).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    for query_id, _ in QUERIES:
        terms = phrases.get(query_id, [])
        rows = con.execute("SELECT rowid, -bm25(f, 1.0, 4.0, 4.0, 0.5) FROM f WHERE f MATCH ?",
                           (" OR ".join(f'"{p}"' for p in terms),)).fetchall() if terms else []
        assert got.get(query_id, {}).keys() == {i for i, _ in rows}
        for i, score in rows:
            assert got[query_id][i] == pytest.approx(score, abs=1e-9)


def test_repeated_questions_are_searched_once(spark):
    twice = queries(spark).unionByName(spark.createDataFrame([(101, QUERIES[0][1])], "query_id bigint, text string"))
    rows = retrieval.keyword_search(passages(spark), twice, 3).collect()
    by = {q: sorted((r.rank, r.chunk_id) for r in rows if r.query_id == q) for q in (1, 101)}
    assert by[1] == by[101] and by[1]


def vector_tables(spark, n=400, q=30, dim=16):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, dim))
    v[50:60] = v[40]  # exact ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = np.vstack([v[40], rng.normal(size=(q - 1, dim))])
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    make = lambda m, key: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{key} bigint, embedding array<double>")
    return v, w, make(v, "chunk_id"), make(w, "query_id")


@pytest.mark.parametrize("matrix_rows", [1000, 5])
def test_dense_scan_and_grid_are_exact(spark, matrix_rows):
    v, w, vectors, asked = vector_tables(spark)
    rows = retrieval.dense_search(vectors, asked, 7, matrix_rows=matrix_rows, corpus_block=90, query_block=8).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    scores = np.round(w @ v.T, 9)
    for i in range(len(w)):
        assert got[i] == list(np.lexsort((np.arange(len(v)), -scores[i]))[:7])


def test_identifier_match_is_substring(spark):
    q = spark.createDataFrame([(1, "about IS 174"), (2, "S.O. 12(E)"), (3, "no number")], "query_id bigint, text string")
    got = {(r.query_id, r.chunk_id) for r in retrieval.identifier_matches(passages(spark), q).collect()}
    assert got == {(1, 1), (1, 3), (2, 2)}


def test_boost_lifts_a_chunk_no_ranker_found(spark):
    v, w, vectors, asked = vector_tables(spark, n=80, q=1)
    q = spark.createDataFrame([(0, "zzz IS 174", [1.0] + [0.0] * 15)], "query_id bigint, text string, embedding array<double>")
    hits = retrieval.search(passages(spark), vectors, q, "hybrid").collect()
    assert {r.chunk_id for r in hits} >= {1, 3}
    with pytest.raises(ValueError):
        retrieval.search(passages(spark), None, q, "semantic")


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id int, rank int")
    run = lambda x, y: sorted(map(tuple, retrieval.reciprocal_rank_fusion(x.unionByName(y)).collect()))
    assert run(a, b) == run(b, a)
    assert dict((c, s) for _, c, s in run(a, b))[11] == pytest.approx(1 / 61 + 1 / 62)
    assert retrieval.reciprocal_rank_fusion(a.limit(0)).count() == 0


def test_group_limit_in_plan(spark):
    hits = retrieval.keyword_search(passages(spark), queries(spark), 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BatchEvalPython" not in plan
    assert lx.TOP_K == 8
