"""Steps of ``document_answers`` that do a thing once or many at a time, against plain ways."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granthi.operators import answers, bounded, pivots
from granthi.operators.index import hashed_vector, hashed_vectors
from granthi.session import dealt


def test_vectors_equal_the_column_and_a_token_is_hashed_once(spark, tmp_path):
    texts = [None, "", "...", "The tree, the TREE", "Élan 42 मानक ब्यूरो", "a " * 700 + "b", *[f"tree {i % 7} of {i % 5}" for i in range(60)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    want = {r.id: r.e for r in rows.select("id", hashed_vector(F.col("text")).alias("e")).collect()}
    got = hashed_vectors(rows, ["id"])
    assert {r.id: r.embedding for r in got.collect()} == want and len(want) == len(texts)
    assert got.schema["embedding"].dataType.simpleString() == "array<double>"
    assert hashed_vectors(rows.limit(0), ["id", "text"]).columns == ["id", "text", "embedding"]


@pytest.mark.parametrize("cells", [1, 1 << 17])
def test_a_block_gives_the_best_passages_of_all_queries(monkeypatch, cells):
    monkeypatch.setattr(bounded, "SLAB_CELLS", cells)
    g = np.random.default_rng(3)
    pairs = sorted({(int(40 * g.random() ** 2), int(c)) for c in g.integers(0, 90, 1500)})
    rows = pd.DataFrame([(p, 500 + c, float(g.integers(1, 4)), 20 + c % 3) for p, c in pairs], columns=["p", "chunk_id", "f", "dl"])
    gains = pd.DataFrame([(q, int(p), float(g.integers(1, 5))) for q in range(30) for p in g.choice(45, 6, replace=False)], columns=["query_id", "p", "gain"])
    gains["least"], gains["avgdl"] = np.where(gains.query_id % 3 == 0, np.nan, np.where(gains.query_id % 3 == 1, 9.0, 1e9)), 21.0
    k = 5
    joined = rows.merge(gains, on="p")
    norm = joined.f + bounded.K1 * (1 - bounded.B + bounded.B * joined.dl / 21.0)
    joined["score"] = joined.gain * joined.f * (bounded.K1 + 1) / norm
    want = joined.groupby(["query_id", "chunk_id", "least"], dropna=False)["score"].sum().reset_index()
    want = want[want.least.isna() | (want.score >= want.least)]

    def best(found):
        found = found.assign(s=np.rint(found.score * 1e9)).sort_values(["query_id", "s", "chunk_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)[["query_id", "chunk_id", "s"]].values.tolist()

    got = bounded.best_of_block(rows, bounded._arrays(gains), k)
    assert best(got) == best(want) and not (got.query_id % 3 == 2).any()
    assert got.groupby("query_id").size().max() <= k


def test_parts_of_the_queries_are_all_of_them():
    gains = pd.DataFrame([(q, p, 1.0 + p, float(q), 2.0) for q in range(7) for p in range(q % 3 + 1)], columns=["query_id", "p", "gain", "least", "avgdl"])
    whole = bounded._arrays(gains)
    for parts in (1, 3, 10):
        cut = [bounded._part(whole, i, parts) for i in range(parts)]
        for i in (0, 2, 3, 4):
            assert np.concatenate([c[i] for c in cut]).tolist() == whole[i].tolist()
        assert np.concatenate([np.diff(c[1]) for c in cut]).tolist() == np.diff(whole[1]).tolist()


def test_best_blocks_are_opened_until_they_hold_k_vectors():
    g = np.random.default_rng(8)
    bounds, rows = g.normal(size=(50, 30)), g.integers(1, 6, 30)
    for k in (1, 7, 60, 500):
        order = np.argsort(-bounds, axis=1)
        before = np.cumsum(rows[order], axis=1) - rows[order]
        want = np.zeros(bounds.shape, bool)
        np.put_along_axis(want, order, before < k, axis=1)
        assert (pivots._first(bounds, rows, k) == want).all()


def test_quotes_are_looked_for_once(spark):
    hits = spark.createDataFrame([(1, 1, "a.txt", 1, "A Tree stands. No. The TREE and a House; end.")],
                                 "query_id long, rank int, relpath string, page_number int, text string")
    asked = spark.createDataFrame([(1, "tree house", "English")], "query_id long, text string, language string")
    found = answers.extractive_answers(asked, hits)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.;:])") == 1
    assert found.first().answer.endswith("    The TREE and a House;\n    A Tree stands.")


def test_small_rows_of_costly_groups_keep_their_tasks(spark):
    rows = spark.range(40).withColumn("block", F.col("id") % 2)
    seen = dealt(rows, 2, "block").groupBy("block").applyInPandas(lambda pdf: pdf.head(1), "id long, block long")
    assert dealt(rows, 2, "block").rdd.getNumPartitions() == 8 and seen.rdd.getNumPartitions() == 8
    assert dealt(rows, 1 << 30, "block").rdd.getNumPartitions() < 1 << 10
