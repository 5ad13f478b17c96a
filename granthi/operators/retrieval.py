"""Batch retrieval: BM25, exact cosine, rank fusion, identifier boost, hybrid top-k.

Queries are a table (query_id, text); results are tables keyed by query. Passage text never
enters a ranking shuffle: the k winners are hydrated at the end.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.text import (
    QUERY_SYNTAX, gazette_numbers, identifiers, search_tokens, split_words, standard_numbers,
)
from granthi.operators.index import corpus_stats, postings, token_arrays
from granthi.session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, broadcast_if_small, fits_broadcast, materialise

# Functions that run in Python workers travel with the task: workers need no package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Ranks are taken on scores rounded to 9 places, so equal passages tie and the id decides.
RANK_DIGITS = 9
QUERY_MATRIX_ROWS = 20_000
RANKED_ROWS = 100
GRID_CORPUS_ROWS = 50_000
LISTED_PHRASES = 1_000
GRID_QUERY_ROWS = 5_000
# Cells of the score matrix held at once in a task.
SCORE_CELLS = 4_000_000
# Pairs of a query and a passage that one task of an indexed search may have to sum.
TASK_PAIRS = 1 << 19


def query_phrases(text: Column, max_terms: int | None = None) -> Column:
    """Phrases of a query, each an array of index tokens: identifiers first, then terms.

    All terms count unless ``max_terms`` asks for the first ones only.
    """
    words = F.filter(
        split_words(F.translate(text, QUERY_SYNTAX, " " * len(QUERY_SYNTAX))), lambda t: F.length(t) > 1
    )
    content = F.filter(words, lambda t: ~F.lower(t).isin(lx.QUERY_STOPWORDS))
    kept = F.when(F.size(content) > 0, content).otherwise(words)
    if max_terms is not None:
        kept = F.slice(kept, 1, max_terms)
    phrases = F.concat(identifiers(text), kept)
    return F.filter(F.transform(phrases, lambda p: search_tokens(p)), lambda p: F.size(p) > 0)


def query_terms(queries: DataFrame) -> DataFrame:
    """Phrases of each query with their multiplicity: a repeated phrase counts again."""
    return (
        queries.select("query_id", F.explode(query_phrases(F.col("text"))).alias("terms"))
        .groupBy("query_id", F.array_join("terms", " ").alias("phrase"))
        .agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("times"))
    )


def _grams(tokens: Column, lengths: list[int]) -> Column:
    """Space-joined runs of the asked lengths; only the lengths that some phrase has."""
    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*[runs(n) for n in lengths])


def _listed_grams(tokens: Column, listed: list[list[str]]) -> Column:
    """The grams of a text that are among the listed ones, found by their first token."""
    by_length: dict[int, list[list[str]]] = {}
    for terms in listed:
        by_length.setdefault(len(terms), []).append(terms)

    def runs(n: int, wanted: list[list[str]]) -> Column:
        if n == 1:
            return F.filter(tokens, lambda t: t.isin([w[0] for w in wanted]))
        opening = sorted({w[0] for w in wanted})
        starts = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(opening), i + 1)), lambda i: i.isNotNull())
        grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.filter(grams, lambda g: g.isin([" ".join(w) for w in wanted]))

    return F.concat(*[runs(n, wanted) for n, wanted in sorted(by_length.items())])


def phrase_matches(tokens: DataFrame, phrases: DataFrame, weights: dict[str, float],
                   lengths: list[int], small: bool) -> DataFrame:
    """Weighted occurrences f of each phrase in each chunk that holds it: phrase, chunk_id, f, dl.

    A phrase of n tokens meets the n-grams of the text, so no frequent token is ever joined on
    its own behalf. The matched postings are partitioned by chunk once; the sums per (phrase,
    chunk) and later per (query, chunk) both live inside that partitioning, hence no shuffle
    of query-chunk pairs, and a phrase that a third of the chunks hold is spread over all tasks.
    """
    wanted = phrases.select("phrase").distinct()
    # A stated number keeps adaptive execution from merging these partitions: the matches are
    # small, but each grows by the number of queries that share its phrase.
    partitions = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # A short list is looked up where the tokens lie, so that only what is wanted becomes a row.
    listed = [r.terms for r in phrases.select("terms").distinct().limit(LISTED_PHRASES + 1).collect()] if small else []
    listed = listed if len(listed) <= LISTED_PHRASES else []

    def weighted(column: str, weight: float) -> Column:
        grams = _listed_grams(F.col(column), listed) if listed else _grams(F.col(column), lengths)
        return F.transform(grams, lambda g: F.struct(g.alias("phrase"), F.lit(weight).alias("w")))

    rows = F.concat(*[weighted(c, w) for c, w in weights.items()])
    return (
        tokens.select("chunk_id", "dl", F.explode(rows).alias("p"))
        .select("chunk_id", "dl", "p.phrase", "p.w")
        .join(F.broadcast(wanted) if small else wanted, "phrase")
        .repartition(partitions, "chunk_id")
        .groupBy("phrase", "chunk_id").agg(F.sum("w").alias("f"), F.max("dl").alias("dl"))
    )


def bm25_scores(passages: DataFrame, queries: DataFrame,
                weights: dict[str, float] = lx.PASSAGE_WEIGHTS) -> DataFrame:
    """BM25 of every (query, chunk) pair that shares a phrase: query_id, chunk_id, score."""
    tokens = token_arrays(passages, list(weights))
    phrases = query_terms(queries)
    small, lengths = _measured(phrases)
    return _bm25(phrase_matches(tokens, phrases, weights, lengths or [1], small), corpus_stats(tokens), phrases, small)


def _measured(phrases: DataFrame) -> tuple[bool, list[int]]:
    """One small job: whether the phrases (with their gains) may be broadcast, and the lengths in use."""
    n_phrases, size, lengths = phrases.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase") + 40), F.lit(0)),
        F.sort_array(F.collect_set(F.size("terms"))),
    ).first()
    return n_phrases <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES, lengths


def score_partitions(stats: DataFrame, phrases: DataFrame) -> int:
    """Parts of the passages, so many that a part meets all queries in at most about TASK_PAIRS pairs: it grows with the index."""
    pairs = stats.first()["n_chunks"] * phrases.agg(F.count_distinct("query_id")).first()[0]
    return max(int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))


def stored_matches(postings: DataFrame, doc_len: DataFrame, phrases: DataFrame, weights: dict[str, float],
                   small: bool, partitions: int) -> DataFrame:
    """The same as ``phrase_matches`` from stored postings: no text and no token array is read.

    A phrase of n tokens occurs where the postings of all its tokens agree on a start. As there, the matches lie by chunk in a
    stated number of partitions, which adaptive execution does not merge; the sums per query live inside them.
    """
    terms = phrases.select("phrase", "terms").distinct().select("phrase", F.size("terms").alias("n"),
                                                                F.posexplode("terms").alias("offset", "term"))
    held = postings.filter(F.col("col").isin(list(weights))).join(F.broadcast(terms) if small else terms, "term")
    weight = F.lit(0.0)
    for column, w in weights.items():
        weight = F.when(F.col("col") == column, F.lit(float(w))).otherwise(weight)
    single = held.filter("n = 1").select("phrase", "chunk_id", weight.alias("w"))
    runs = (
        held.filter("n > 1").groupBy("phrase", "n", "chunk_id", "col", (F.col("pos") - F.col("offset")).alias("start"))
        .count().filter(F.col("count") == F.col("n")).select("phrase", "chunk_id", weight.alias("w"))
    )
    return (
        single.union(runs).repartition(partitions, "chunk_id").groupBy("chunk_id", "phrase").agg(F.sum("w").alias("f"))
        .join(doc_len.select("chunk_id", "dl"), "chunk_id")
    )


def keyword_index(passages: DataFrame, weights: dict[str, float] = lx.PASSAGE_WEIGHTS) -> dict[str, DataFrame]:
    """What a keyword search reads: postings, doc_len and corpus_stats, to be written once."""
    tokens = token_arrays(passages, list(weights))
    return {"postings": postings(tokens, list(weights)), "doc_len": tokens.select("chunk_id", "dl"),
            "corpus_stats": corpus_stats(tokens)}


def indexed_search(index: dict[str, DataFrame], queries: DataFrame, k: int,
                   weights: dict[str, float] = lx.PASSAGE_WEIGHTS) -> DataFrame:
    """BM25 top-k over a written index: query_id, chunk_id, score, rank."""
    def run(asked: DataFrame) -> DataFrame:
        phrases = query_terms(asked)
        small, _ = _measured(phrases)
        partitions = score_partitions(index["corpus_stats"], phrases)
        matches = stored_matches(index["postings"], index["doc_len"], phrases, weights, small, partitions)
        return top_k(_bm25(matches, index["corpus_stats"], phrases, small), k)

    return per_distinct_text(queries, run)


def _bm25(matches: DataFrame, stats: DataFrame, phrases: DataFrame, small: bool) -> DataFrame:
    """Scores from matches (phrase, chunk_id, f, dl) and one row of statistics."""
    # Reads the same columns as the scoring branch, so both branches reuse one shuffle.
    frequency = matches.groupBy("phrase").agg(
        F.count_if((F.col("f") > 0) & (F.col("dl") > 0)).alias("df")
    )
    return _summed(matches, _gains(phrases, frequency, F.broadcast(stats)), small)


def _gains(phrases: DataFrame, frequency: DataFrame, stats: DataFrame) -> DataFrame:
    """What each found phrase of a query counts: query_id, phrase, times, gain, avgdl."""
    idf = F.greatest(
        F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(lx.IDF_FLOOR)
    )
    return phrases.select("query_id", "phrase", "times").join(frequency, "phrase").crossJoin(stats).select(
        "query_id", "phrase", "times", (F.col("times") * idf).alias("gain"), "avgdl"
    )


def _summed(matches: DataFrame, gains: DataFrame, small: bool) -> DataFrame:
    f = F.col("f")
    saturation = f * (lx.BM25_K1 + 1) / (
        f + lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * F.col("dl") / F.col("avgdl"))
    )
    wanted = gains.select("query_id", "phrase", "gain", "avgdl")
    return (
        matches.join(F.broadcast(wanted) if small else wanted, "phrase")
        .groupBy("query_id", "chunk_id").agg(F.sum(F.col("gain") * saturation).alias("score"))
    )


def top_k(scored: DataFrame, k: int, ties: list[Column] | None = None) -> DataFrame:
    """The k best rows per query with their rank; planned as a partial then final group limit."""
    # rint of the scaled score orders like rounding, without a decimal conversion per row.
    order = [F.rint(F.col("score") * 10.0 ** RANK_DIGITS).desc(), *(ties or []), F.col("chunk_id")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def per_distinct_text(queries: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a ranking once per distinct text and hand the rows to every query that asks it.

    A small set of distinct texts is broadcast, so a text that a third of the queries repeat
    is not gathered in one task; a large set is a shuffle join that AQE splits when skewed.
    """
    first = queries.groupBy("text").agg(F.min("query_id").alias("first_id"))
    # A ranking has at most RANKED_ROWS rows per text, so this bounds what is broadcast of it as well.
    small = fits_broadcast(first, max_rows=BROADCAST_MAX_ROWS // RANKED_ROWS)
    ranked = run(first.select(F.col("first_id").alias("query_id"), "text")).withColumnRenamed("query_id", "first_id")
    same = queries.join(F.broadcast(first) if small else first, "text").select("query_id", "first_id")
    columns = [c for c in ranked.columns if c != "first_id"]
    return same.join(F.broadcast(ranked) if small else ranked, "first_id").select("query_id", *columns)


def keyword_search(passages: DataFrame, queries: DataFrame, k: int,
                   weights: dict[str, float] = lx.PASSAGE_WEIGHTS) -> DataFrame:
    """BM25 top-k: query_id, chunk_id, score, rank.

    Chunks that hold the same phrases equally often and are equally long score alike for every query, so of each such group only
    the k first ids can be hits, and the group is scored once. Queries whose found phrases agree share one ranking. Both are exact.
    """
    return per_distinct_text(queries, lambda q: _ranked_by_profile(passages, q, k, weights))


def _ranked_by_profile(passages: DataFrame, queries: DataFrame, k: int, weights: dict[str, float]) -> DataFrame:
    tokens = token_arrays(passages, list(weights))
    phrases = materialise(query_terms(queries), "phrases")
    small, lengths = _measured(phrases)
    profiles = materialise(
        phrase_matches(tokens, phrases, weights, lengths or [1], small)
        .groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("phrase", "f"))).alias("held"), F.max("dl").alias("dl"))
        .withColumn("profile", _spelled("held", "f")), "profiles")
    # The hash leads, so that sorting rarely compares long profiles.
    alike = [F.xxhash64("profile", "dl").alias("h"), "profile", "dl"]
    order = Window.partitionBy("h", "profile", "dl").orderBy("chunk_id")
    first = profiles.select(*alike, "chunk_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    groups = materialise(first.groupBy("h", "profile", "dl").agg(F.min("chunk_id").alias("chunk_id"), F.collect_list("chunk_id").alias("members")), "groups")
    frequency = (
        profiles.groupBy("profile", "dl").agg(F.first("held").alias("held"), F.count(F.lit(1)).alias("n"))
        .select(F.explode(F.transform(F.filter("held", lambda p: p["f"] > 0), lambda p: p["phrase"])).alias("phrase"), "n")
        .groupBy("phrase").agg(F.sum("n").alias("df")))
    stats = F.broadcast(corpus_stats(tokens))
    gains = materialise(_gains(phrases, frequency, stats), "gains")
    asked = gains.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("phrase", "times"))).alias("terms")).select(
        "query_id", _spelled("terms", "times").alias("asks"))
    asked = materialise(asked, "asked")
    leaders = asked.groupBy("asks").agg(F.min("query_id").alias("leader"))
    leading = gains.join(leaders.select(F.col("leader").alias("query_id")), "query_id", "left_semi")
    held = groups.join(profiles.select("chunk_id", "held"), "chunk_id").select(
        "chunk_id", "dl", F.explode("held").alias("p")).select("chunk_id", "dl", "p.*")
    best = top_k(_summed(held, leading, small), k)
    hits = top_k(best.drop("rank").join(groups.select("chunk_id", "members"), "chunk_id").select(
        "query_id", "score", F.explode("members").alias("chunk_id")), k)
    same = asked.join(broadcast_if_small(leaders), "asks").select("query_id", "leader")
    return same.join(broadcast_if_small(hits.withColumnRenamed("query_id", "leader")), "leader").select("query_id", "chunk_id", "score", "rank")


def _spelled(pairs: str, value: str) -> Column:
    """Phrases with a number each as one text; tokens hold neither of the separators."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["phrase"], F.lit(":"), p[value].cast("string"))), "|")


# --- dense -----------------------------------------------------------------------


def _keep_best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """First k per row number by (rounded score desc, id asc), over flat arrays."""
    order = np.lexsort((ids, -np.round(scores, RANK_DIGITS), rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], ids[keep], scores[keep]


def _block_top(ids: np.ndarray, matrix: np.ndarray, queries: np.ndarray, k: int, state):
    """Fold one block of vectors into the running k best per query, slab by slab of queries."""
    slab = max(1, SCORE_CELLS // max(1, len(ids)))
    found = [] if state is None else [state]
    for start in range(0, len(queries), slab):
        scores = queries[start:start + slab] @ matrix.T
        if scores.shape[1] > k:
            # Ties with the k-th score all stay, so that the id decides among equals.
            edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            rows, cols = np.nonzero(scores >= edge[:, None] - 10.0 ** -RANK_DIGITS)
        else:
            rows, cols = np.nonzero(np.ones(scores.shape, dtype=bool))
        found.append((rows + start, ids[cols], scores[rows, cols]))
    return _keep_best(*[np.concatenate(parts) for parts in zip(*found)], k)


def _emit(query_ids: np.ndarray, state) -> pd.DataFrame:
    rows, ids, scores = state
    return pd.DataFrame({"query_id": query_ids[rows], "chunk_id": ids, "score": scores})


RESULT_SCHEMA = "query_id bigint, chunk_id bigint, score double"


def dense_search(vectors: DataFrame, queries: DataFrame, k: int,
                 matrix_rows: int = QUERY_MATRIX_ROWS, corpus_block: int = GRID_CORPUS_ROWS,
                 query_block: int = GRID_QUERY_ROWS) -> DataFrame:
    """Exact cosine top-k over all vectors: query_id, chunk_id, score, rank.

    ``vectors`` is (chunk_id, embedding), ``queries`` (query_id, embedding), both unit length.
    A query table of at most ``matrix_rows`` rows is shipped to the tasks as a matrix and the
    vectors are scanned where they lie. A larger one is met in a grid: both sides are cut into
    blocks of bounded size and each (vector block, query block) cell is one bounded group.
    """
    head = queries.select("query_id", "embedding").limit(matrix_rows + 1).toPandas()
    if len(head) == 0:
        return top_k(queries.sparkSession.createDataFrame([], RESULT_SCHEMA), k)
    if len(head) <= matrix_rows:
        local = _scan_with_matrix(vectors, head, k)
    else:
        local = _grid_search(vectors, queries, k, corpus_block, query_block)
    return top_k(local, k)


def _scan_with_matrix(vectors: DataFrame, head: pd.DataFrame, k: int) -> DataFrame:
    query_ids = head["query_id"].to_numpy(dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast(
        (query_ids, np.stack(head["embedding"].to_numpy()).astype(np.float64))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        state = None
        for pdf in batches:
            if len(pdf):
                block = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                state = _block_top(pdf["chunk_id"].to_numpy(dtype=np.int64), block, matrix, k, state)
        if state is not None:
            yield _emit(ids, state)

    return vectors.select("chunk_id", "embedding").mapInPandas(scan, RESULT_SCHEMA)


def _grid_search(vectors: DataFrame, queries: DataFrame, k: int, corpus_block: int,
                 query_block: int) -> DataFrame:
    v_cells = max(1, -(-vectors.count() // corpus_block))
    q_cells = max(1, -(-queries.count() // query_block))

    def spread(df: DataFrame, key: str, own: str, own_cells: int, other: str, other_cells: int) -> DataFrame:
        return df.select(
            F.col(key), "embedding",
            F.pmod(F.xxhash64(key), F.lit(own_cells)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_cells - 1))).alias(other),
        )

    left = spread(vectors, "chunk_id", "vc", v_cells, "qc", q_cells)
    right = spread(queries, "query_id", "qc", q_cells, "vc", v_cells)

    def cell(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        matrix = np.stack(v["embedding"].to_numpy()).astype(np.float64)
        wanted = np.stack(q["embedding"].to_numpy()).astype(np.float64)
        state = _block_top(v["chunk_id"].to_numpy(dtype=np.int64), matrix, wanted, k, None)
        return _emit(q["query_id"].to_numpy(dtype=np.int64), state)

    return left.groupBy("vc", "qc").cogroup(right.groupBy("vc", "qc")).applyInPandas(cell, RESULT_SCHEMA)


# --- fusion ----------------------------------------------------------------------


def reciprocal_rank_fusion(rankings: DataFrame, k: int = lx.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) per (query_id, chunk_id) over any number of rankings."""
    return rankings.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def identifier_matches(chunks: DataFrame, queries: DataFrame, k: int = lx.TOP_K) -> DataFrame:
    """Chunks whose identifier strings contain an identifier of the query.

    Contained means substring: a standard number also finds longer numbers it begins. A wanted
    string begins with a letter and its first digit run starts a digit run of the containing
    string, so the join runs on that run (all prefixes from three digits on for standards,
    whole runs for gazette numbers) and ``contains`` decides. The k first chunks by page are
    taken once per distinct identifier, then handed to the queries that name it.
    """
    wanted = queries.select("query_id", F.posexplode(
        F.concat(
            F.transform(standard_numbers(F.col("text")), lambda s: F.struct(s.alias("w"), F.lit("s").alias("kind"))),
            F.transform(gazette_numbers(F.col("text")), lambda s: F.struct(s.alias("w"), F.lit("g").alias("kind"))),
        )
    ).alias("nth", "i")).select(
        "query_id", "nth", F.col("i.w").alias("identifier"), F.col("i.kind").alias("kind"),
        F.regexp_extract(F.col("i.w"), r"\d+", 0).alias("run"),
    )
    needles = broadcast_if_small(wanted.select("identifier", "kind", "run").distinct())

    def runs(col: str) -> Column:
        return F.regexp_extract_all(F.col(col), F.lit(r"\d+"), F.lit(0))

    prefixes = F.flatten(F.transform(
        F.filter(runs("is_numbers"), lambda r: F.length(r) >= 3),
        lambda r: F.transform(F.sequence(F.lit(3), F.length(r)), lambda n: F.substring(r, F.lit(1), n)),
    ))
    keyed = chunks.where((F.col("is_numbers") != "") | (F.col("gazette_refs") != "")).select(
        "chunk_id", "page_number", "is_numbers", "gazette_refs",
        F.explode(F.array_distinct(F.concat(
            F.transform(prefixes, lambda r: F.struct(F.lit("s").alias("kind"), r.alias("run"))),
            F.transform(runs("gazette_refs"), lambda r: F.struct(F.lit("g").alias("kind"), r.alias("run"))),
        ))).alias("key"),
    ).select("chunk_id", "page_number", "is_numbers", "gazette_refs", "key.*")
    holds = F.when(F.col("kind") == "s", F.col("is_numbers")).otherwise(F.col("gazette_refs"))
    found = (
        keyed.join(needles, ["kind", "run"]).where(holds.contains(F.col("identifier")))
        .select("identifier", "chunk_id", "page_number")
    )
    order = Window.partitionBy("identifier").orderBy("page_number", "chunk_id")
    first = found.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= k)
    return (
        first.join(wanted.select("query_id", "nth", "identifier"), "identifier")
        .groupBy("query_id", "chunk_id")
        .agg(F.min(F.col("nth") * k + F.col("seq")).alias("boost_pos"))
    )


def fuse(keyword: DataFrame, semantic: DataFrame, boost: DataFrame | None = None,
         top: int = lx.TOP_K, rrf_k: int = lx.RRF_K) -> DataFrame:
    """Hybrid ranking from candidate lists; one aggregation keyed by (query, chunk).

    Ties follow the keyword rank, then the semantic rank, then the boost order.
    """
    none_i, none_d = F.lit(None).cast("int"), F.lit(None).cast("double")
    parts = keyword.select(
        "query_id", "chunk_id", F.col("rank").alias("kr"), F.col("score").alias("ks"),
        none_i.alias("sr"), none_d.alias("ss"), none_i.alias("bp"),
    ).unionByName(semantic.select(
        "query_id", "chunk_id", none_i.alias("kr"), none_d.alias("ks"),
        F.col("rank").alias("sr"), F.col("score").alias("ss"), none_i.alias("bp"),
    ))
    if boost is not None:
        parts = parts.unionByName(boost.select(
            "query_id", "chunk_id", none_i.alias("kr"), none_d.alias("ks"), none_i.alias("sr"),
            none_d.alias("ss"), F.col("boost_pos").cast("int").alias("bp"),
        ))
    merged = parts.groupBy("query_id", "chunk_id").agg(
        F.max("kr").alias("keyword_rank"), F.max("ks").alias("keyword_score"),
        F.max("sr").alias("semantic_rank"), F.max("ss").alias("semantic_score"),
        F.max("bp").alias("boost_pos"),
    )

    def share(rank: str) -> Column:
        return F.when(F.col(rank).isNotNull(), 1.0 / (rrf_k + F.col(rank))).otherwise(0.0)

    scored = merged.withColumn(
        "score",
        share("keyword_rank") + share("semantic_rank")
        + F.when(F.col("boost_pos").isNotNull(), F.lit(1.0 / rrf_k)).otherwise(0.0),
    )
    ties = [F.col(c).asc_nulls_last() for c in ("keyword_rank", "semantic_rank", "boost_pos")]
    return top_k(scored, top, ties).drop("boost_pos")


def search(passages: DataFrame, vectors: DataFrame | None, queries: DataFrame, mode: str = "hybrid",
           top: int = lx.TOP_K, candidates: int = lx.CANDIDATE_K,
           keyword: Callable[[DataFrame, int], DataFrame] | None = None,
           dense: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Hits of one mode: query_id, chunk_id, rank, score and both rankers' ranks and scores.

    ``queries`` is (query_id, text) plus ``embedding`` where a vector exists. A mode whose table
    is missing raises, keyword search never needs vectors. ``keyword`` and ``dense`` rank (queries, k) over a
    written index in place of the passages and vectors.
    """
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "keyword" and vectors is None and dense is None:
        raise ValueError(f"mode {mode} is unavailable: no vectors")
    keyword = keyword or (lambda asked, k: keyword_search(passages, asked, k))
    dense = dense or (lambda asked, k: dense_search(vectors, asked, k))
    null_i, null_d = F.lit(None).cast("int"), F.lit(None).cast("double")
    if mode == "keyword":
        hits = keyword(queries, top)
        return hits.select(
            "query_id", "chunk_id", "rank", "score", F.col("rank").alias("keyword_rank"),
            F.col("score").alias("keyword_score"), null_i.alias("semantic_rank"), null_d.alias("semantic_score"),
        )
    asked = queries.where(F.col("embedding").isNotNull())
    if mode == "semantic":
        hits = dense(asked, top)
        return hits.select(
            "query_id", "chunk_id", "rank", "score", null_i.alias("keyword_rank"),
            null_d.alias("keyword_score"), F.col("rank").alias("semantic_rank"),
            F.col("score").alias("semantic_score"),
        )
    return fuse(
        keyword(queries, candidates),
        dense(asked, candidates),
        identifier_matches(passages, queries, top),
        top,
    ).select("query_id", "chunk_id", "rank", "score", "keyword_rank", "keyword_score",
             "semantic_rank", "semantic_score")


def hydrate(hits: DataFrame, passages: DataFrame, most_hits: int | None = None) -> DataFrame:
    """Join the winners to their passages; an unknown chunk drops out and the others are numbered anew from 1.

    Ranks are numbered on ids, before any text is joined, so every use of a hit counts alike.

    ``most_hits`` is a proven bound (queries times k): below the broadcast limit the passages
    are not shuffled.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    few = most_hits is not None and most_hits <= BROADCAST_MAX_ROWS
    if few:
        # The ids of the hits meet the passages first, so that no other passage's text is made.
        hits = materialise(hits, "hits")
        passages = passages.join(F.broadcast(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    known = passages.select("chunk_id")
    hits = hits.join(F.broadcast(known.distinct()) if few else known, "chunk_id", "left_semi").withColumn(
        "rank", F.row_number().over(by_rank))
    if few:
        hits = F.broadcast(hits)
    sources = F.array_compact(F.array(
        F.when(F.col("keyword_rank").isNotNull(), F.lit("keyword")),
        F.when(F.col("semantic_rank").isNotNull(), F.lit("semantic")),
    ))
    return passages.join(hits, "chunk_id").select(
        "query_id", "rank", "chunk_id", "score", "keyword_rank", "keyword_score", "semantic_rank",
        "semantic_score", sources.alias("sources"), "relpath", "page_number", "title", "category",
        "source_url", "text",
        F.concat_ws(" p.", "relpath", F.col("page_number").cast("string")).alias("citation"),
    )


def serialise(hits: DataFrame) -> DataFrame:
    """JSON of each hydrated hit: score at 6 places, rankers sorted, citation."""
    return hits.select("query_id", "rank", F.to_json(F.struct(
        "chunk_id", "title", "category", "relpath", "page_number", "citation",
        F.round("score", 6).alias("score"), F.sort_array("sources").alias("matched_by"),
        "keyword_rank", "semantic_rank", "text",
    )).alias("hit"))


def mode_overlap(keyword: DataFrame, semantic: DataFrame, hybrid: DataFrame,
                 queries: DataFrame) -> DataFrame:
    """Per query: chunks of one ranker only, of both, and hybrid rows in neither (rank order).

    Each list holds at most top-k chunks, so the collected sets are bounded.
    """
    def ids(df: DataFrame, name: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))
        return df.groupBy("query_id").agg(F.transform(rows, lambda r: r["chunk_id"]).alias(name))

    none = F.array().cast("array<bigint>")
    all_ids = (
        queries.select("query_id").join(ids(keyword, "k"), "query_id", "left")
        .join(ids(semantic, "s"), "query_id", "left").join(ids(hybrid, "h"), "query_id", "left")
        .select("query_id", *[F.coalesce(c, none).alias(c) for c in ("k", "s", "h")])
    )
    return all_ids.select(
        "query_id",
        F.sort_array(F.array_except("k", "s")).alias("keyword_only"),
        F.sort_array(F.array_except("s", "k")).alias("semantic_only"),
        F.sort_array(F.array_intersect("k", "s")).alias("found_by_both"),
        F.filter("h", lambda c: ~F.array_contains("k", c) & ~F.array_contains("s", c)).alias("hybrid_unique"),
    )


def exact_route(queries: DataFrame, index: DataFrame, k: int = lx.TOP_K) -> DataFrame:
    """Chunks that carry an identifier of the query exactly, ahead of any fuzzy search.

    Ranked once per identifier by page, so a popular identifier is cut to k before it meets
    the queries.
    """
    wanted = queries.select("query_id", F.explode(identifiers(F.col("text"))).alias("identifier"))
    order = Window.partitionBy("identifier").orderBy("page_number", "chunk_id")
    best = index.join(broadcast_if_small(wanted.select("identifier").distinct()), "identifier").withColumn(
        "seq", F.row_number().over(order)
    ).where(F.col("seq") <= k)
    return wanted.join(best, "identifier").select(
        "query_id", "identifier", "chunk_id", F.col("seq").alias("position"), F.lit("exact").alias("route")
    )


CLAUSE = r"(?i)\bclause\s+(\d+(?:\.\d+)*)"


def clause_numbers(text: Column) -> Column:
    """Distinct numbers of the clauses that a text names, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(1)))


def clause_index(passages: DataFrame) -> DataFrame:
    """(identifier, clause, chunk_id, page_number) of passages that name both; a null text has none."""
    return passages.select(
        "chunk_id", "page_number", F.explode(identifiers(F.col("text"))).alias("identifier"), clause_numbers(F.col("text")).alias("clauses"),
    ).select("identifier", F.explode("clauses").alias("clause"), "chunk_id", "page_number")


def exact_first(queries: DataFrame, identifier_rows: DataFrame, clause_rows: DataFrame, hits: DataFrame, k: int = lx.TOP_K) -> DataFrame:
    """Exact hits ahead of searched ones: query_id, rank, chunk_id, route.

    First the chunks that name an identifier and a clause of the query together, then those that name an identifier, both by page and
    id, then ``hits`` in their order; a chunk keeps its first place and k remain. Each identifier, and each identifier with a clause, is
    cut to its k first chunks before it meets the queries: at most k places are taken by earlier stages, so none that remains is lost.
    """
    wanted = queries.select("query_id", F.explode(identifiers(F.col("text"))).alias("identifier"), clause_numbers(F.col("text")).alias("clauses"))
    pairs = wanted.select("query_id", "identifier", F.explode("clauses").alias("clause"))

    def routed(asked: DataFrame, rows: DataFrame, keys: list[str], stage: int, route: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("page_number", "chunk_id")
        known = rows.select(*keys, "page_number", "chunk_id").join(broadcast_if_small(asked.select(*keys).distinct()), keys)
        best = known.distinct().withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= k)
        return asked.join(best, keys).select(
            "query_id", "chunk_id", F.lit(stage).alias("stage"), F.col("page_number").cast("long").alias("place"), F.lit(route).alias("route"))

    found = routed(pairs, clause_rows, ["identifier", "clause"], 0, "clause").unionByName(
        routed(wanted.select("query_id", "identifier"), identifier_rows, ["identifier"], 1, "identifier")).unionByName(
        hits.select("query_id", "chunk_id", F.lit(2).alias("stage"), F.col("rank").cast("long").alias("place"), F.lit("search").alias("route")))
    first = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("stage", "place", "route")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.stage", "f.place", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "f.route")
