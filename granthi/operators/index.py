"""Keyword index (tokens, postings, lengths, statistics), identifier index and vectors."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from granthi.functions.text import let, search_tokens

# Functions that run in Python workers travel with the task: workers need no package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def token_arrays(passages: DataFrame, columns: list[str], key: str = "chunk_id") -> DataFrame:
    """Token array per text column and the unweighted length over all of them."""
    arrays = passages.select(
        key, *[search_tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns]
    )
    total = sum((F.size(c) for c in columns[1:]), F.size(columns[0]))
    return arrays.withColumn("dl", total)


def postings(tokens: DataFrame, columns: list[str], key: str = "chunk_id") -> DataFrame:
    """One row per occurrence: term, chunk, column, position."""
    parts = [
        tokens.select(key, F.lit(c).alias("col"), F.posexplode(c).alias("pos", "term")) for c in columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("term", key, "col", "pos")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length."""
    return tokens.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))


def identifier_index(chunks: DataFrame) -> DataFrame:
    """Distinct (identifier, chunk)."""
    ids = F.array_distinct(F.concat("standard_ids", "gazette_ids"))
    return chunks.select(F.explode(ids).alias("identifier"), "chunk_id", "page_number")


# --- vectors ---------------------------------------------------------------------

Embedder = Callable[[list[str]], np.ndarray]


def l2_normalised(vector: Column) -> Column:
    """Unit-length copy of a vector, so that a dot product is a cosine."""
    def squares(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))

    def scaled(v: Column, norm: Column) -> Column:
        return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))

    return let(vector, lambda v: let(F.sqrt(squares(v)), lambda norm: scaled(v, norm)))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Built-in embedder: hashed bag of words, unit length, the same for query and passage.

    A token's slot is the first 28 bits of its MD5 modulo ``dim``, so that all slots are met. The sorted slots are counted by
    one fold that appends once per slot, so the cost grows with the text, not text times slots.
    """
    slots = F.sort_array(F.transform(
        search_tokens(text),
        lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("int") % dim),
    ))
    empty = F.struct(
        F.lit(-1).alias("slot"), F.lit(0).alias("n"),
        F.array().cast("array<struct<slot:int,n:int>>").alias("out"),
    )

    def closed(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["slot"].alias("slot"), s["n"].alias("n"))))

    counts = F.aggregate(
        slots, empty,
        lambda s, x: F.when(s["slot"] == x, F.struct(
            s["slot"].alias("slot"), (s["n"] + 1).alias("n"), s["out"].alias("out")
        )).otherwise(F.struct(x.alias("slot"), F.lit(1).alias("n"), closed(s).alias("out"))),
        lambda s: F.map_from_entries(closed(s)),
    )
    return l2_normalised(let(counts, lambda found: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(found[i], F.lit(0)).cast("double")
    )))


# Tokens of which a task keeps the slot.
KNOWN_TOKENS = 1 << 20


def hashed_vectors(rows: DataFrame, keep: list[str], text: str = "text", dim: int = 64) -> DataFrame:
    """The columns ``keep`` and ``embedding``, equal to ``hashed_vector`` of the text: a task hashes a token once, not wherever it stands."""
    tokens = rows.select(*keep, search_tokens(F.col(text)).alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def slot(token: bytes) -> int:
            if token not in known:
                known[token] = int(hashlib.md5(token, usedforsecurity=False).hexdigest()[:7], 16) % dim
            return known[token]

        for batch in batches:
            if len(known) > KNOWN_TOKENS:
                known.clear()
            lists, n = batch.column(len(keep)), batch.num_rows
            words = lists.flatten().dictionary_encode()
            slots = np.array([slot(w) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            row = np.repeat(np.arange(n), np.asarray(lists.value_lengths().fill_null(0)))
            counts = np.bincount(row * dim + slots[np.asarray(words.indices)], minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(dim)), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], [*keep, "embedding"])

    schema = rows.select(*keep).schema.add("embedding", ArrayType(DoubleType()))
    return tokens.mapInArrow(run, schema)


def missing_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def embed_missing(chunks: DataFrame, vectors: DataFrame, embedder: Embedder | None = None,
                  dim: int = 64, batch: int = 256) -> DataFrame:
    """Vectors of the chunks that lack one: (chunk_id, embedding).

    Without an embedder the built-in hashed vector is used, entirely in the JVM. A supplied
    embedder is called on Arrow batches, so a model is loaded once per Python worker.
    """
    todo = missing_chunks(chunks, vectors).select("chunk_id", "text")
    if embedder is None:
        return todo.select("chunk_id", hashed_vector(F.col("text"), dim).cast("array<float>").alias("embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                matrix = np.asarray(embedder(part["text"].tolist()), dtype=np.float32)
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": list(matrix)})

    return todo.mapInPandas(run, "chunk_id bigint, embedding array<float>")


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embedded and total chunks."""
    marked = chunks.select("chunk_id").join(
        vectors.select("chunk_id").distinct().withColumn("has", F.lit(1)), "chunk_id", "left"
    )
    return marked.agg(
        F.count("has").alias("embedded"),
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.try_divide(F.count("has"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"),
    )
