"""Exact top-k by integer inner product: norm-bucketed retrieval with length and coordinate pruning.

Components are quantised to floor(scale * x). Candidates are range-partitioned by length (then id, so equal lengths spread)
and lie in their tasks from the longest to the shortest. Queries come in blocks of bounded size that are sent to all
tasks, one block after the other; the candidates stay where they are. A pilot over a share of the
candidates gives each query a true lower bound of its k-th score. In each bucket of a task:

* length: a query whose bound exceeds its length times the bucket's greatest length has nothing to find in it;
* coordinate: the bound over both lengths is the cosine a candidate needs here. It confines each coordinate of the unit
  candidate to an interval; where the best of the query's largest coordinates leaves few candidates, only those are
  multiplied, else the whole bucket is.

Every remaining product is computed, so the result is exact; bounds only rise. Ties go to the smaller id. A query's own id
is no candidate. Null vectors, vectors with null or non-finite components and rows without an id take no part; vectors of
different lengths don't meet. A repeated query id is asked once (with its smallest vector), repeated
candidates count each time. Scores are exact while their absolute value is below 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthi.llm.common import matrix
from granthi.session import materialise

BUCKET = 1024
QUERY_BLOCK = 8192  # queries sent to the tasks at a time
PILOT_ROWS = 8192
FOCUS = 4
FEW = 0.25
SLACK = 1e-9  # relative, for bounds computed in floating point


class Best:
    """The k best candidates of each query so far, and the score a further one needs at least."""

    def __init__(self, bound: np.ndarray, k: int) -> None:
        self.k, self.bound = k, bound.astype(np.float64).copy()
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        begins = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(begins, np.arange(len(query)), 0))
        full = rank == self.k - 1
        self.bound[query[full]] = np.maximum(self.bound[query[full]], score[full])
        held = rank < self.k
        self.query, self.score, self.id = query[held], score[held], ids[held]


class Block:
    """Queries of one length with what pruning needs of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.angle = np.arccos(np.clip(self.unit, -1, 1))

    def search(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray, best: Best) -> None:
        """Meet one bucket."""
        reach = self.length * length.max() * (1 + SLACK)
        alive = np.flatnonzero(best.bound <= reach)
        if not len(alive):
            return
        need = np.clip(np.where(reach[alive] > 0, best.bound[alive] / np.maximum(reach[alive], 1e-300), -1), -1, 1)
        need = np.where(np.isfinite(need), need, -1)
        few = self._coordinate(alive, need, vectors, length) if length.min() > 0 else {}
        dense = alive[[q not in few for q in alive]] if few else alive
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(dense):
            score = self.vectors[dense] @ vectors.T
            q, c = np.nonzero((score >= best.bound[dense][:, None]) & (self.ids[dense][:, None] != ids[None, :]))
            found.append((dense[q], score[q, c], ids[c]))
        for q, rows in few.items():
            score = vectors[rows] @ self.vectors[q]
            held = (score >= best.bound[q]) & (ids[rows] != self.ids[q])
            found.append((np.full(held.sum(), q), score[held], ids[rows][held]))
        if found:
            best.add(*(np.concatenate(p) for p in zip(*found)))

    def _coordinate(self, alive: np.ndarray, need: np.ndarray, vectors: np.ndarray,
                    length: np.ndarray) -> dict[int, np.ndarray]:
        """Rows to multiply for the queries whose needed cosine leaves few of them.

        A candidate at most a from the query and the axis b from it is between b - a and b + a from the axis.
        """
        hard = need > 0.3
        if not hard.any():
            return {}
        alive, away = alive[hard], np.arccos(need[hard])
        unit = vectors / length[:, None]
        order = np.argsort(unit, axis=0)
        ordered = np.take_along_axis(unit, order, axis=0)
        begin = np.zeros((len(alive), FOCUS), np.int64)
        end = np.full((len(alive), FOCUS), len(unit), np.int64)
        focus = self.focus[alive]
        for f in np.unique(focus):
            q, slot = np.nonzero(focus == f)
            to_axis = self.angle[alive[q], f]
            begin[q, slot] = np.searchsorted(ordered[:, f], np.cos(np.minimum(np.pi, to_axis + away[q])) - SLACK)
            end[q, slot] = np.searchsorted(ordered[:, f], np.cos(np.maximum(0, to_axis - away[q])) + SLACK, "right")
        width = end - begin
        slot = width.argmin(axis=1)
        out = {}
        for i in np.flatnonzero(width[np.arange(len(alive)), slot] <= FEW * len(unit)):
            s = slot[i]
            out[int(alive[i])] = order[begin[i, s]: end[i, s], focus[i, s]]
        return out


def _search(blocks, bounds, k: int):
    """Task: its candidates against one block of queries -> (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {dims: (Block(ids, vectors), Best(bounds.value[dims], k)) for dims, (ids, vectors) in blocks.value.items()}
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column(2).offsets))
            for dims in set(np.unique(lengths)) & own.keys():
                rows = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                ids, norm = np.asarray(rows.column(0)), np.asarray(rows.column(1))
                vectors = matrix(rows.column(2), np.float64)
                block, best = own[dims]
                for a in range(0, len(ids), BUCKET):
                    part = slice(a, a + BUCKET)
                    block.search(ids[part], vectors[part], norm[part], best)
        for block, best in own.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[best.query]), pa.array(best.id), pa.array(best.score.astype(np.int64))],
                ["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    parts = F.col("vector")
    whole = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(key).cast("long").alias("vec_id"), is_query.alias("query"),
                       F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & parts.isNotNull() & F.coalesce(whole, F.lit(False)))
        .withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))
        .withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    )
    all_rows = materialise(rows.select("vec_id", "length", "vector", "query")
                           .repartitionByRange(F.desc("length"), F.col("vec_id"))
                           .sortWithinPartitions(F.desc("length"), "vec_id"), "candidates")
    # Files keep the order of their rows, so buckets hold similar lengths; each bucket measures its own.
    candidates = all_rows.select("vec_id", "length", "vector")
    asked = materialise(all_rows.filter(F.coalesce("query", F.lit(False))).groupBy("vec_id")
                        .agg(F.min("vector").alias("vector")), "queries")
    n, n_queries = all_rows.count(), asked.count()
    n_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    share = min(1.0, PILOT_ROWS / max(n, 1))
    pilot = candidates.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    results = []
    for i in range(n_blocks):
        rows_of = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks)) == i).toArrow()
        by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lists = rows_of.column("vector").combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
        for dims in np.unique(lengths):
            at = pa.array(np.flatnonzero(lengths == dims))
            by_dims[int(dims)] = (np.asarray(rows_of.column("vec_id").combine_chunks().take(at)),
                                  matrix(lists.take(at), np.float64))
        blocks = spark.sparkContext.broadcast(by_dims)
        lowest = {d: np.full(len(ids), -np.inf) for d, (ids, _) in by_dims.items()}
        schema = "query_id long, vec_id long, score long"
        first = spark.sparkContext.broadcast(lowest)
        seen = _ranked(pilot.mapInArrow(_search(blocks, first, k), schema), k).filter(F.col("rank") == k) \
            .select("query_id", "score").toArrow()
        known = dict(zip(seen.column(0).to_pylist(), seen.column(1).to_pylist()))
        bounds = spark.sparkContext.broadcast(
            {d: np.array([known.get(int(q), -np.inf) for q in ids]) for d, (ids, _) in by_dims.items()})
        results.append(materialise(_ranked(candidates.mapInArrow(_search(blocks, bounds, k), schema), k), "top"))
        for sent in (blocks, first, bounds):
            sent.unpersist()
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select("query_id", "rank", "vec_id", "score")
