"""Exact routes ahead of searched hits."""

from granthi.operators import retrieval
from granthi.operators.index import identifier_index
from pyspark.sql import functions as F


def test_clauses_then_identifiers_then_hits(spark):
    rows = [(i, 9 - i % 9, f"Text {i} on IS 302. Clause {i % 2 + 4}.1 applies.") for i in range(40)] + [
        (50, 1, "IS 999 has no clauses"), (51, 1, "clause 4.1 of nothing"), (52, 1, None)]
    passages = spark.createDataFrame(rows, "chunk_id bigint, page_number int, text string")
    passages = passages.withColumn("standard_ids", retrieval.standard_numbers(F.coalesce("text", F.lit("")))).withColumn(
        "gazette_ids", F.array().cast("array<string>"))
    asked = spark.createDataFrame([(1, "What says CLAUSE 4.1 of IS 302?"), (2, "What is IS 999"), (3, "clause 4.1"), (4, None)],
                                  "query_id bigint, text string")
    hits = spark.createDataFrame([(q, r, c) for q in (1, 2, 3) for r, c in ((1, 51), (2, 50), (3, 0))], "query_id bigint, rank int, chunk_id bigint")
    for k in (3, 25, 100):
        got = {}
        for r in sorted(retrieval.exact_first(asked, identifier_index(passages), retrieval.clause_index(passages), hits, k).collect(),
                        key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.chunk_id, r.route))
        page = {c: p for c, p, _ in rows}
        by_page = sorted(range(40), key=lambda i: (page[i], i))
        first = [(i, "clause") for i in by_page if i % 2 == 0] + [(i, "identifier") for i in by_page if i % 2]
        assert got[1] == (first + [(51, "search"), (50, "search")])[:k]
        assert got[2] == [(50, "identifier"), (51, "search"), (0, "search")][:k]
        assert got[3] == [(51, "search"), (50, "search"), (0, "search")][:k]
        assert 4 not in got
