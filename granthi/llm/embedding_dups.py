"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe and verification.

Equal vectors are one class from the start (128-bit hash), so a vector that a third of all rows repeat is hashed
once. A hash turns a vector by three rounds of random signs and Hadamard transform and takes the axis it is
closest to; ``hashes`` of them name a bucket. Each vector lies in its bucket and in the one that the least certain axis
would give next (multiprobe), in every table. Buckets with one member go before vectors are attached.
Large buckets are cut into blocks whose pairs meet in tasks of their own; a pair that shares several buckets
counts in the smallest. Candidates are verified by cosine in double precision, so no link is below
the threshold. Tables are set for a found share of ``RECALL`` of the pairs at the threshold itself; closer pairs
are found more often.

Vectors that are null, zero, or hold null or non-finite components link with nothing; rows without an id
take no part (no links, no component). Vectors of different lengths don't link. A repeated id is a vector each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.llm.common import U64, local_components, map_batches, matrix, mix, whole_groups
from granthi.llm.components import components
from granthi.session import materialise

RECALL = 0.98
BLOCK = 512
# Chance that one hash, with its share of the probe, agrees for two vectors at cosine 0.9 (measured, 64 dimensions).
AGREE = 0.60
BUCKET_ROWS = 256


def plan(n: int, dims: int) -> tuple[int, int]:
    """(hashes per table, tables): about ``BUCKET_ROWS`` unrelated vectors in a bucket, and the recall."""
    hashes = max(2, math.ceil(math.log(max(n, 2) / BUCKET_ROWS) / math.log(2 * dims)))
    return hashes, math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE ** hashes))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; the width is a power of two."""
    width, step = x.shape[1], 1
    while step < width:
        halves = x.reshape(len(x), width // (2 * step), 2, step)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(x.shape)
        step *= 2
    return x


def bucket_keys(vectors: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """Keys of the bucket and of the probed bucket in each table: rows x tables x 2."""
    dims = vectors.shape[1]
    width = 1 << max(1, (dims - 1).bit_length())
    x = np.zeros((len(vectors), width), np.float32)
    x[:, :dims] = vectors
    signs = np.random.default_rng(width).choice(np.array([-1, 1], np.float32), (tables, hashes, 3, width))
    out = np.empty((len(x), tables, 2), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        codes, nexts, gaps = [], [], []
        for h in range(hashes):
            y = x
            for s in signs[t, h]:
                y = hadamard(y * s)
            size = np.abs(y)
            best = size.argmax(axis=1)
            top = size[rows, best]
            codes.append(2 * best + (y[rows, best] < 0))
            size[rows, best] = -1
            second = size.argmax(axis=1)
            nexts.append(2 * second + (y[rows, second] < 0))
            gaps.append(1 - size[rows, second] / np.maximum(top, 1e-30))
        code, other = np.stack(codes), np.stack(nexts)
        weak = np.stack(gaps).argmin(axis=0)
        probe = code.copy()
        probe[weak, rows] = other[weak, rows]
        for i, c in enumerate((code, probe)):
            key = np.full(len(x), t * 1_000_003 + dims, U64)
            for part in c:
                key = mix(key + part.astype(U64) + U64(1))
            out[:, t, i] = key.view(np.int64)
    return out


def _hashed(hashes: int, tables: int):
    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(np.asarray(batch.column(2).offsets))
        for dims in np.unique(lengths):
            rows = batch.take(pa.array(np.flatnonzero(lengths == dims)))
            x = matrix(rows.column(2), np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = bucket_keys(x, hashes, tables).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(list(x), pa.list_(pa.float64())),
                 pa.array(list(keys), pa.list_(pa.int64()))], ["rep", "n", "unit", "keys"])
    return step


def _verified(threshold: float):
    """Links inside each group: (rep, links, near). ``links`` counts the pairs whose smallest shared bucket this is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["key", "i", "j"]):
            key, left, right, block, rep, n = (np.asarray(rows.column(c)) for c in ("key", "i", "j", "block", "rep", "n"))
            lengths = np.diff(np.asarray(rows.column("unit").combine_chunks().offsets))
            own, links, near = [], [], []
            for a, b in zip(starts, [*starts[1:], len(rep)]):
                if b - a < 2 or lengths[a] != lengths[a:b].min() or lengths[a] != lengths[a:b].max():
                    continue
                unit = matrix(rows.column("unit").slice(a, b - a), np.float64)
                linked = unit @ unit.T >= threshold
                np.fill_diagonal(linked, False)
                linked &= rep[a:b, None] != rep[None, a:b]
                if left[a] != right[a]:  # pairs inside a block meet where the block meets itself
                    linked &= block[a:b, None] != block[None, a:b]
                x, y = np.nonzero(linked)
                if not len(x):
                    continue
                keys = matrix(rows.column("keys").slice(a, b - a), np.int64).reshape(b - a, -1, 2)
                counts = np.zeros(b - a, np.int64)
                for c in range(0, len(x), 1 << 15):
                    u, v = x[c: c + (1 << 15)], y[c: c + (1 << 15)]
                    shared = (keys[u][:, :, :, None] == keys[v][:, :, None, :]).any(axis=3)
                    first = np.where(shared, keys[u], np.iinfo(np.int64).max).min(axis=(1, 2)) == key[a]
                    np.add.at(counts, u[first], n[a:b][v[first]])
                order = np.argsort(rep[a:b], kind="stable")
                label = np.empty(b - a, np.int64)
                label[order] = rep[a:b][order][local_components(linked[np.ix_(order, order)])]
                held = np.flatnonzero(linked.any(axis=1))
                own.append(rep[a:b][held])
                links.append(counts[held])
                near.append(label[held])
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (own, links, near)],
                                                 ["rep", "links", "near"])
    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    parts = F.col("vector")
    good = (
        F.col("id").isNotNull() & parts.isNotNull() & (F.size(parts) > 0)
        & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(parts, lambda x: x != 0)
    )
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")) \
        .withColumn("good", F.coalesce(good, F.lit(False))) \
        .withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    classes = materialise(
        rows.filter("good").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                                    F.any_value("vector").alias("vector")), "classes")
    n, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    hashes, tables = plan(n, 1 << max(1, ((dims or 1) - 1).bit_length()))
    hashed = materialise(map_batches(classes.select("rep", "n", "vector"),
                                     "rep long, n long, unit array<double>, keys array<long>",
                                     _hashed(hashes, tables)), "hashed")
    members = hashed.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    met = (
        members.join(crowded, "key").withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("rep", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    found = materialise(
        met.join(hashed, "rep").select("key", "i", "j", "block", "rep", "n", "unit", "keys")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInArrow(_verified(threshold), "rep long, links long, near long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("near").alias("b")))
    labelled = (
        classes.select("k1", "k2", "rep", "n")
        .join(links, "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component"))
    )
    return (
        rows.filter("good").select("id", "k1", "k2").join(labelled, ["k1", "k2"]).select("id", "n_links", "component")
        .union(rows.filter(~F.col("good")).select("id", F.lit(0).cast("long"), F.col("id")))
        .select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"),
                F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
    )
