"""Queries over the given tables for the corpus operators, and their SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthi.llm import (attention_lm, conversation_repair, embedding_dups, html_text, jaccard_join, lang_id, mixing, periodic_runs, piece_bpe, run_index, substring_dedup,
                         tool_calls, top_products)
from granthi.llm.common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document text, learned from three quarters of the labelled documents."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs, fold("doc_id", 4) != 2)
    found = lang_id.predict(docs.withColumn("held_out", fold("doc_id", 4) == 2), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 1.5 times the corpus, weighted by source, takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


# Tools of the calls that op3_tool_calls derives: name, field, JSON type, required.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", True),
         ("count", "limit", "number", True), ("count", "exact", "boolean", False),
         ("note", "query", "string", True), ("note", "limit", "string", False)]


def tool_use(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of conversations: assistant turns are calls, all others (without a role too) results."""
    turns = turns.withColumn("words", mixing.word_count("text"))
    by_turn = lambda c: F.concat(F.lit("call-"), c.cast("string"))
    tool = F.element_at(F.array(*map(F.lit, ("search", "count", "note", "other"))),
                        (F.pmod("words", F.lit(4)) + 1).cast("int"))
    arguments = F.to_json(F.struct(
        F.col("words").alias("limit"), F.when(F.pmod("words", F.lit(3)) > 0, F.col("text")).alias("query"),
        F.when(F.pmod("words", F.lit(5)) == 0, F.lit(True)).alias("exact")))
    needs = lambda n: by_turn(F.floor(F.col("turn") / n))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", by_turn(F.col("turn")).alias("call_id"), F.col("turn").alias("place"), tool.alias("name"),
        arguments.alias("arguments"), F.when(F.col("turn") > 0, F.array(needs(2), needs(3))).alias("depends"))
    results = turns.filter(~F.col("role").eqNullSafe(F.lit("assistant"))).select(
        "conv_id", by_turn(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content"))
    rows = ", ".join(f"('{name}', '{field}', '{kind}', {required})" for name, field, kind, required in TOOLS)
    return calls, results, turns.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(name, field, kind, required)")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool use: assistant turns are calls, the turns after them results.

    The number of words of a turn chooses the tool, so that some arguments don't fit their schema; the whole text is an
    argument; a call needs the calls at a half and at a third of its turn. ``status`` tells linked calls from what has no link:
    orphan and spare results, calls with a repeated id or without one.
    """
    calls, results, schemas = tool_use(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, schemas).withColumn("status", F.lit("call"))
    return linked.unionByName(tool_calls.unlinked(calls, results), allowMissingColumns=True)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document text and the text they decode to, as counts and digests."""
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links at Jaccard 0.8 over five-word shingles for every document."""
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the words of repeated windows of 20 words."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return top_products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document text by word counts and by the attention model."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 7) == 2)
    learned = attention_lm.fit(docs, ~F.col("held_out"), public_tokenizers.path("piece_bpe_32k.model"))
    return attention_lm.score(docs, learned, keep=("held_out",))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 and their components for every vector."""
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 50-byte strings that a document with a smaller id has."""
    return run_index.remove_matches(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of which get a planted period."""
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest edits that bring every damaged conversation into order."""
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_tool_calls": op3_tool_calls,
    "op4_html_text": op4_html_text,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_topk": op8_exact_topk,
    "op9_lm_score": op9_lm_score,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_run_index": op11_run_index,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op2_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents
        ), sizes AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM docs GROUP BY source
        ), pairs AS (
            SELECT a.source, a.source_size, a.weight, 2.0 * a.source_size AS most,
                   sum(CASE WHEN b.source_size * 2.0 / b.weight < a.source_size * 2.0 / a.weight THEN 2.0 * b.source_size ELSE 0 END) AS below,
                   sum(CASE WHEN b.source_size * 2.0 / b.weight < a.source_size * 2.0 / a.weight THEN 0 ELSE b.weight END) AS open_weight,
                   1.5 * sum(b.source_size) AS budget
            FROM sizes a, sizes b GROUP BY ALL
        ), goals AS (
            SELECT source, source_size,
                   least(most, weight * (SELECT max((budget - below) / open_weight) FROM pairs
                                         WHERE (budget - below) / open_weight <= most / weight)) AS target
            FROM pairs
        ), budgets AS (
            SELECT *, floor(target + 1e-6)::BIGINT AS b, floor(floor(target + 1e-6) / greatest(source_size, 1))::BIGINT AS epochs
            FROM goals
        ), placed AS (
            SELECT doc_id, size, source_size, target, b, epochs,
                   coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY k, doc_id, size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM docs JOIN budgets ON docs.source IS NOT DISTINCT FROM budgets.source
        )
        SELECT doc_id, size, source_size, target::DOUBLE AS target,
               (epochs * size + greatest(0, least(size, b - epochs * source_size - before)))::BIGINT AS taken
        FROM placed""",
    "op7_substring_dedup": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
        ), places AS (
            SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs
        ), windows AS (
            SELECT doc_id, i, row_number() OVER (
                PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS later
            FROM places
        ), gone AS (
            SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS w FROM windows WHERE later
        ), lists AS (
            SELECT doc_id, list(w) AS ws, count(*) AS n FROM gone GROUP BY doc_id
        )
        SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE
                   list_filter(words, lambda x, j: NOT list_contains(ws, j)) END, ' ')) AS kept_sha256
        FROM docs d LEFT JOIN lists USING (doc_id)""",
    "op8_exact_topk": r"""
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
            FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5""",
    "op3_tool_calls": r"""
        WITH RECURSIVE turns AS (
            SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words FROM conversations
        ), calls AS (
            SELECT conv_id, turn, words, ['search', 'count', 'note', 'other'][(words % 4 + 1)::INT] AS name,
                   CASE WHEN words % 3 > 0 THEN text END AS query, words % 5 = 0 AS exact
            FROM turns WHERE role = 'assistant'
        ), needs AS (
            SELECT DISTINCT a.conv_id, a.turn, b.turn AS needed FROM calls a JOIN calls b
            ON a.conv_id = b.conv_id AND a.turn > 0 AND b.turn IN (a.turn // 2, a.turn // 3)
        ), paths AS (
            SELECT conv_id, turn, turn AS at, 0 AS depth FROM calls
            UNION
            SELECT p.conv_id, p.turn, n.needed, depth + 1 FROM paths p JOIN needs n ON p.conv_id = n.conv_id AND p.at = n.turn
        ), levels AS (
            SELECT conv_id, turn, max(depth)::INT AS level FROM paths GROUP BY ALL
        ), linked AS (
            SELECT c.*, l.level, r.turn IS NOT NULL AS has_result, r.text AS content,
                   list_sort(list_filter([
                       CASE WHEN name = 'other' THEN 'unknown tool' END,
                       CASE WHEN name IN ('search', 'note') AND query IS NULL THEN 'missing: query' END,
                       CASE WHEN name = 'note' THEN 'wrong type: limit' END,
                       CASE WHEN name IN ('search', 'note') AND exact THEN 'not in schema: exact' END,
                       CASE WHEN name = 'count' AND query IS NOT NULL THEN 'not in schema: query' END
                   ], lambda x: x IS NOT NULL)) AS errs
            FROM calls c JOIN levels l USING (conv_id, turn)
            LEFT JOIN turns r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role IS DISTINCT FROM 'assistant'
        ), alone AS (
            SELECT r.* FROM turns r LEFT JOIN calls c ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
            WHERE r.role IS DISTINCT FROM 'assistant' AND c.turn IS NULL
        )
        SELECT conv_id, 'call-' || turn AS call_id, turn AS place, name, level, has_result, len(errs) = 0 AS valid,
               array_to_string(errs, '; ') AS errors,
               '{"arguments":{' || CASE WHEN exact THEN '"exact":true,' ELSE '' END || '"limit":' || words
               || coalesce(',"query":' || to_json(query)::VARCHAR, '') || '},"id":"call-' || turn || '","level":' || level
               || ',"name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json, 'call' AS status
        FROM linked
        UNION ALL
        SELECT conv_id, 'call-' || (turn - 1), turn, NULL, NULL, NULL, NULL, NULL,
               '{"id":' || coalesce('"call-' || (turn - 1) || '"', 'null') || ',"result":' || coalesce(to_json(text)::VARCHAR, 'null') || '}',
               'orphan result'
        FROM alone""",
    "op11_run_index": r"""
        WITH docs AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
        ), windows AS (
            SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM docs
        ), cut AS (
            SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS w FROM windows
        ), firsts AS (
            SELECT w, min(doc_id) AS first FROM cut GROUP BY w HAVING min(doc_id) < max(doc_id)
        ), marked AS (
            SELECT doc_id, i, i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM cut JOIN firsts USING (w) WHERE doc_id > first
        ), spans AS (
            SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
                SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked)
            GROUP BY doc_id, g
        ), lists AS (
            SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id
        )
        SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda j:
                   substring(h, (2 * CASE WHEN j = 0 THEN 0 ELSE b[j] END + 1)::BIGINT,
                             (2 * (CASE WHEN j = len(a) THEN n ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE b[j] END))::BIGINT)), '') END))
                   AS kept_sha256
        FROM docs d LEFT JOIN lists USING (doc_id)""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s
            FROM conversations
        ), summed AS (
            SELECT *, xor(4294967295::BIGINT, list_reduce(
                list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT),
                lambda c, b: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7],
                    lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
                4294967295::BIGINT)) % 20 AS kind
            FROM given
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM summed WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                   NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
        ), faults AS (
            SELECT *, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND open_end AS truncated FROM placed
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
            FROM faults GROUP BY conv_id
        ), best AS (
            SELECT conv_id, 0::BIGINT AS k, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS b0,
                   NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS b1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS b2,
                   NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS b3
            FROM counts
            UNION ALL
            SELECT conv_id, k,
                   d0,
                   list_sort(list_filter([d1, CASE WHEN r = 's' THEN k0 END], lambda x: x IS NOT NULL))[1],
                   list_sort(list_filter([d2, CASE WHEN r = 'u' THEN k0 END, CASE WHEN r = 'u' THEN k1 END,
                                          CASE WHEN r = 'u' THEN k3 END, r0, r1, r3], lambda x: x IS NOT NULL))[1],
                   list_sort(list_filter([d3, CASE WHEN r = 'a' THEN k2 END, r2], lambda x: x IS NOT NULL))[1]
            FROM (
                SELECT conv_id, k, r,
                       CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} END AS d0,
                       CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t} END AS d1,
                       CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t} END AS d2,
                       CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t} END AS d3,
                       CASE WHEN s0 IS NOT NULL AND f THEN {'c': s0.c + w, 'a': s0.a || 'K', 't': list_append(s0.t, line)} END AS k0,
                       CASE WHEN s1 IS NOT NULL AND f THEN {'c': s1.c + w, 'a': s1.a || 'K', 't': list_append(s1.t, line)} END AS k1,
                       CASE WHEN s2 IS NOT NULL AND f THEN {'c': s2.c + w, 'a': s2.a || 'K', 't': list_append(s2.t, line)} END AS k2,
                       CASE WHEN s3 IS NOT NULL AND f THEN {'c': s3.c + w, 'a': s3.a || 'K', 't': list_append(s3.t, line)} END AS k3,
                       CASE WHEN s0 IS NOT NULL AND f THEN {'c': s0.c + w + 1, 'a': s0.a || 'R', 't': list_append(s0.t, 'user:' || text)} END AS r0,
                       CASE WHEN s1 IS NOT NULL AND f THEN {'c': s1.c + w + 1, 'a': s1.a || 'R', 't': list_append(s1.t, 'user:' || text)} END AS r1,
                       CASE WHEN s2 IS NOT NULL AND f THEN {'c': s2.c + w + 1, 'a': s2.a || 'R', 't': list_append(s2.t, 'assistant:' || text)} END AS r2,
                       CASE WHEN s3 IS NOT NULL AND f THEN {'c': s3.c + w + 1, 'a': s3.a || 'R', 't': list_append(s3.t, 'user:' || text)} END AS r3
                FROM (
                    SELECT conv_id, k, r, f, w, line, text, s0, s1, s2,
                           list_sort(list_filter([s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': list_append(s2.t, 'assistant:')}],
                                                 lambda x: x IS NOT NULL))[1] AS s3
                    FROM (
                        SELECT b.conv_id, f.k, f.role[1] AS r, NOT (blank OR duplicate) AS f, CASE WHEN truncated THEN 5 ELSE 0 END AS w,
                               role || ':' || text AS line, text, b0 AS s0, b1 AS s1, b3 AS s3,
                               list_sort(list_filter([b2,
                                   CASE WHEN b0 IS NOT NULL THEN {'c': b0.c + 5, 'a': b0.a || 'I', 't': list_append(b0.t, 'user:')} END,
                                   CASE WHEN b1 IS NOT NULL THEN {'c': b1.c + 5, 'a': b1.a || 'I', 't': list_append(b1.t, 'user:')} END,
                                   CASE WHEN b3 IS NOT NULL THEN {'c': b3.c + 5, 'a': b3.a || 'I', 't': list_append(b3.t, 'user:')} END
                               ], lambda x: x IS NOT NULL))[1] AS s2
                        FROM best b JOIN faults f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = b.k + 1
                    )
                )
            )
        ), ends AS (
            SELECT b.conv_id, list_sort(list_filter([b0, b3,
                       CASE WHEN b2 IS NOT NULL THEN {'c': b2.c + 5, 'a': b2.a || 'I', 't': list_append(b2.t, 'assistant:')} END,
                       CASE WHEN b1 IS NOT NULL THEN {'c': b1.c + 10, 'a': b1.a || 'II', 't': b1.t || ['user:', 'assistant:']} END
                   ], lambda x: x IS NOT NULL))[1] AS e
            FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.k = c.n
        )
        SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost,
               coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) g
        LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends d ON g.conv_id IS NOT DISTINCT FROM d.conv_id""",
}
