"""Join of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Documents with the same shingle set are one class (128-bit hash of the set); a class is handled once.
2. MinHash LSH forest: ``TREES`` tries over the classes, each over the next minima of a signature. Matched prefixes start
   at full depth and are shortened until a pair at the threshold meets in some trie with the target recall
   (``depth_for``). Tries are kept as sorted prefixes: what shares a prefix is one group of rows. Groups of
   one go before signatures are attached; large ones are cut into blocks whose pairs meet in tasks of their own.
   Pairs whose signatures agree in too few places to be similar are left out, the others bound candidate clusters.
3. Exact verification inside clusters: the shingles of the texts themselves, again in blocks; every pair of a cluster
   is compared once, so a text's number of links is exact within its cluster.

Links are counted, never listed: each task reports per class the linked documents and one link that keeps its local
component together. Classes of the result are the components over verified links, named by the smallest id.

Texts of one to four words are one shingle. Null texts and texts without words have no shingles and link with
nothing. Rows with a null id take no part (no links, null class). Ids are expected to be unique: equal rows with one id
count as documents each; of different texts under one id only one is compared with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.llm.common import (U64, Rolling, local_components, local_index, map_batches, matrix, mix, steps,
                                text_bytes, whole_groups, words_of)
from granthi.llm.components import components
from granthi.session import materialise

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.99
BLOCK = 512
DEVIATIONS = 4.0

_SHINGLES = Rolling(0xC2B2AE3D27D4EB4F)
_SIZE = TREES * DEPTH
_FACTORS = mix(np.arange(1, _SIZE + 1, dtype=U64)) | U64(1)
_OFFSETS = mix(np.arange(1001, _SIZE + 1001, dtype=U64))


def depth_for(threshold: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEPTH) -> int:
    """Longest prefix at which a pair at the threshold shares one in some trie with the wanted probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in turn, sorted within it, and where each text's begin."""
    words, firsts = words_of(texts)
    row, place, size = local_index(firsts)
    at = np.flatnonzero((place + WORDS <= size) | ((place == 0) & (size < WORDS)))
    hashed = _SHINGLES.spans(words, at, at + np.minimum(size[at], WORDS))
    row = row[at]
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    hashed, row = hashed[new], row[new]
    return hashed, np.searchsorted(row, np.arange(len(texts) + 1))


def _signed(depth: int):
    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(doc_id, f1, f2, keys, signature); texts without shingles have null for all but the id."""
        texts = text_bytes(batch.column(1))
        for a, b in steps([len(t) for t in texts]):
            hashed, firsts = shingle_sets(texts[a:b])
            counts = np.diff(firsts)
            held = np.flatnonzero(counts)
            names = ["doc_id", "f1", "f2", "keys", "signature"]
            bare = batch.column(0).slice(a, b - a).take(pa.array(np.flatnonzero(counts == 0)))
            nothing = [pa.nulls(len(bare), kind) for kind in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([bare, *nothing], names)
            if not len(held):
                continue
            starts = firsts[:-1][held]
            with np.errstate(over="ignore"):
                f1 = np.add.reduceat(mix(hashed + U64(1)), starts)
                f2 = np.add.reduceat(mix(hashed ^ U64(0x5555555555555555)), starts) + counts[held].astype(U64)
                minima = np.stack([
                    np.minimum.reduceat((((hashed ^ x) * m) >> U64(32)).astype(np.uint32), starts)
                    for x, m in zip(_OFFSETS, _FACTORS)], axis=1)
            keys = np.empty((len(held), TREES), U64)
            for t in range(TREES):
                key = np.full(len(held), t + 1, U64)
                for label in minima[:, t * DEPTH: t * DEPTH + depth].T:
                    key = mix(key + label.astype(U64) + U64(1))
                keys[:, t] = key
            marks = minima.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a).take(pa.array(held)), pa.array(f1.view(np.int64)),
                pa.array(f2.view(np.int64)), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                pa.array([m.tobytes() for m in marks], pa.binary())], names)
    return step


def _clusters(least: float):
    """Candidate links inside each group of a trie: (rep, near), near the smallest of its local component."""

    def agree(marks: np.ndarray) -> np.ndarray:
        if len(marks) <= 48:
            return (marks[:, None, :] == marks[None, :, :]).sum(axis=2)
        out = np.zeros((len(marks), len(marks)), np.uint16)
        for column in marks.T:
            out += column[:, None] == column[None, :]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["key", "i", "j"]):
            rep = np.asarray(rows.column("rep"))
            marks = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(len(rep), _SIZE)
            ends = np.concatenate([starts[1:], [len(rep)]])
            twos = starts[ends - starts == 2]
            twos = twos[(marks[twos] == marks[twos + 1]).sum(axis=1) >= least * _SIZE]
            own, near = [rep[twos], rep[twos + 1]], [np.minimum(rep[twos], rep[twos + 1])] * 2
            for a, b in zip(starts, ends):
                if b - a > 2:
                    linked = agree(marks[a:b]) >= least * _SIZE
                    order = np.argsort(rep[a:b], kind="stable")
                    label = np.empty(b - a, np.int64)
                    label[order] = rep[a:b][order][local_components(linked[np.ix_(order, order)])]
                    own.append(rep[a:b])
                    near.append(label)
            own, near = np.concatenate(own), np.concatenate(near)
            moved = own != near
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(near[moved])], ["rep", "near"])
    return run


def _shingled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The text column (the last) replaced by its shingle hashes."""
    texts = text_bytes(batch.column(batch.num_columns - 1))
    sets: list[bytes] = []
    for a, b in steps([len(t) for t in texts]):
        hashed, firsts = shingle_sets(texts[a:b])
        sets += [hashed[x:y].tobytes() for x, y in zip(firsts[:-1], firsts[1:])]
    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())],
                                     [*batch.schema.names[:-1], "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence columns, a slice of shingles at a time."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((n, n), np.float32)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    held = shared[where]
    where, owner = column[where[held]], owner[held]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    width = 4096
    for begin in range(0, int(shared.sum()), width):
        x, y = np.searchsorted(where, [begin, begin + width])
        part = np.zeros((n, width), np.float32)
        part[owner[x:y], where[x:y] - begin] = 1
        out += part @ part.T
    return out


def _verified(threshold: float):
    """Verified links inside each group: (rep, links, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["component", "i", "j"]):
            left, right, block, rep, n = (np.asarray(rows.column(c)) for c in ("i", "j", "block", "rep", "n"))
            shingles = rows.column("shingles")
            own, links, near = [], [], []
            for a, b in zip(starts, [*starts[1:], len(rep)]):
                if b - a < 2:
                    continue
                # A repeated row stands once here; its class counts it.
                kept = a + np.unique(rep[a:b], return_index=True)[1]
                sets = [np.frombuffer(shingles[int(i)].as_py(), U64) for i in kept]
                sizes = np.array([len(s) for s in sets], np.float64)
                both = intersections(sets).astype(np.float64)
                linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if left[a] != right[a]:
                    linked &= block[kept][:, None] != block[kept][None, :]
                held = np.flatnonzero(linked.any(axis=1))
                if len(held):  # in ascending order of rep
                    own.append(rep[kept][held])
                    links.append((linked @ n[kept].astype(np.float64)).astype(np.int64)[held])
                    near.append(rep[kept][local_components(linked)][held])
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (own, links, near)],
                                                 ["rep", "links", "near"])
    return run


def blocked(members: DataFrame, group: str, *keep: str) -> DataFrame:
    """Members with their block, once for each pair of blocks (i <= j) of their group that their block is in."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return (
        members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*keep, group, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    signed = materialise(map_batches(named, "doc_id long, f1 long, f2 long, keys array<long>, signature binary",
                                     _signed(depth_for(threshold))), "signatures")
    classes = materialise(
        signed.filter(F.col("f1").isNotNull()).groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"),
             F.any_value("keys").alias("keys"), F.any_value("signature").alias("signature")), "shingle_classes")
    met = classes.select("rep", F.explode("keys").alias("key"))
    crowded = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    least = threshold - DEVIATIONS * (threshold * (1 - threshold) / _SIZE) ** 0.5
    candidates = (
        blocked(met.join(crowded, "key"), "key", "rep").join(classes.select("rep", "signature"), "rep")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInArrow(_clusters(least), "rep long, near long")
    )
    clusters = components(candidates.select(F.col("rep").alias("a"), F.col("near").alias("b"))) \
        .withColumnRenamed("node", "rep")
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = materialise(clusters.join(sizes, "component").join(classes.select("rep", "n"), "rep"), "clusters")
    shingles = map_batches(
        named.withColumnRenamed("doc_id", "rep").join(members, "rep").select("rep", "component", "size", "n", "text"),
        "rep long, component long, size long, n long, shingles binary", _shingled)
    found = materialise(
        blocked(shingles, "component", "rep", "n", "shingles")
        .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
        .mapInArrow(_verified(threshold), "rep long, links long, near long"), "jaccard_links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("near").alias("b"))) \
        .withColumnRenamed("node", "rep")
    labelled = (
        classes.select("f1", "f2", "rep", "n").join(links, "rep", "left").join(joined, "rep", "left")
        .select("f1", "f2", F.coalesce("component", "rep").alias("class_id"),
                (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    none = F.lit(0).cast("long").alias("n_links")
    return (
        signed.select("doc_id", "f1", "f2").join(labelled, ["f1", "f2"]).select("doc_id", "class_id", "n_links")
        .union(signed.filter(F.col("f1").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), none))
        .union(rows.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), none))
    )
