"""Removal of repeated passages: every word of a window of 20 words whose sequence also starts earlier.

1. Documents that are whole copies of an earlier one (128-bit hash of the word sequence) go at once.
2. Anchors: hashes of 8 words, only at places p of a document with p mod 13 in {0, 1, 3, 9}. Every difference modulo
   13 is a difference of two of these, so two equal windows of 20 words share an anchor at the same offset,
   wherever they lie. Four of thirteen places are hashed and shuffled in place of all.
3. Around anchors that occur more than once the match is extended: the windows of 20 words that hold such an
   anchor are hashed (96 bits) and ranked by (document, place) among equal ones. All but the first are removed.

Groups: of the copies of an anchor or a window within one batch of rows only one travels under the hash; the
others are already known to be repeated and travel under a key of their own. So a task gets at most one row per
hash and batch, even when a third of all documents share a passage. The texts are shuffled once, by document.

Null and empty texts have no words. Rows with the same document id count as one document: equal places of it are one start,
so equal rows don't remove each other's words and get equal results, and of different texts each has its own result. Rows
with a null id take no part and are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthi.llm.common import U64, Rolling, local_index, map_batches, mix, numbering, same, steps, text_bytes, words_of
from granthi.session import materialise

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # perfect difference set modulo 13
ANCHOR = WINDOW - PERIOD + 1
KNOWN = 1 << 16  # set in the key of an anchor that is repeated within its batch
LAST_PLACE = (1 << 16) - 1  # anchors further on share this place, and all windows from there on are compared

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_ANCHORS = Rolling(0xD6E8FEB86659FD93)
_WINDOWS = (Rolling(0xA0761D6478BD642F), Rolling(0xE7037ED1A0B428DB))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _later(hashes: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have an equal one before them in this order, rows that are equal to any other).

    Rows that agree in hash and order with the first of their hash are as early as that one.
    """
    place = np.lexsort((*order[::-1], *hashes[::-1])) if hashes.ndim > 1 else np.lexsort((*order[::-1], hashes))
    ordered = hashes[..., place]
    same = (ordered[..., 1:] == ordered[..., :-1]).reshape(-1, len(place) - 1).all(axis=0) if len(place) > 1 \
        else np.zeros(0, bool)
    later, shared = np.zeros(len(place), bool), np.zeros(len(place), bool)
    later[place[1:]] = same
    if order:
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same])[: len(place)], np.arange(len(place)), 0))
        later[place] &= np.any([o[place] != o[place[first]] for o in order], axis=0)
    shared[place[1:]] |= same
    shared[place[:-1]] |= same
    return later, shared


def _fingerprints(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = text_bytes(batch.column(1))
    digests = [hashlib.blake2b(b" ".join(t.tobytes().split()), digest_size=16).digest() for t in texts]
    words = [len(t.tobytes().split()) for t in texts]
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2), pa.array(words, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
        ["doc_id", "hash", "n_words", "f1", "f2"])


def _anchors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(key = 47 bits of hash, KNOWN, 16 bits of place; doc_id)."""
    texts, ids = text_bytes(batch.column(1)), np.asarray(batch.column(0))
    keys, docs = [], []
    for a, b in steps([len(t) for t in texts]):
        words, firsts = words_of(texts[a:b])
        row, place, size = local_index(firsts)
        at = np.flatnonzero(_IN_COVER[place % PERIOD] & (place + ANCHOR <= size) & (size >= WINDOW))
        hashed = _ANCHORS.spans(words, at, at + ANCHOR)
        keys.append((hashed & ~U64(KNOWN | LAST_PLACE)) | np.minimum(place[at], LAST_PLACE).astype(U64))
        docs.append(ids[a:b][row[at]])
    if not keys:
        return
    key, doc = np.concatenate(keys), np.concatenate(docs)
    later, shared = _later(key >> U64(17))
    # Known copies keep their place but travel under a hash of document and place.
    own = mix(doc.view(U64) + mix(key)) & ~U64(KNOWN | LAST_PLACE)
    key = np.where(later, own | (key & U64(LAST_PLACE)), key) | np.where(shared, U64(KNOWN), U64(0))
    yield pa.RecordBatch.from_arrays([_signed(key), pa.array(doc)], ["key", "doc_id"])


def _windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Windows that hold a repeated anchor: (h1, hp = 32 bits of hash, known, 31 of place; doc_id, tag)."""
    texts, ids, anchors, tags = text_bytes(batch.column(1)), np.asarray(batch.column(0)), batch.column(2), np.asarray(batch.column(3))
    flat, offsets = np.asarray(anchors.values).astype(np.int64), np.asarray(anchors.offsets)
    first, second, places, docs, of = [], [], [], [], []
    for a, b in steps([len(t) for t in texts]):
        words, firsts = words_of(texts[a:b])
        row, place, size = local_index(firsts)
        held = np.zeros(len(words) + PERIOD + 1, bool)
        for i in range(a, b):
            own = flat[offsets[i]: offsets[i + 1]]
            begin, end = firsts[i - a], firsts[i - a + 1]
            held[begin + own[own < min(LAST_PLACE, end - begin)]] = True
            if len(own) and own.max() == LAST_PLACE:
                held[begin + LAST_PLACE: end] = True
        count = np.concatenate([[0], np.cumsum(held)])
        at = np.arange(len(words))
        at = at[(count[at + PERIOD] > count[at]) & (place + WINDOW <= size)]
        first.append(_WINDOWS[0].spans(words, at, at + WINDOW))
        second.append(_WINDOWS[1].spans(words, at, at + WINDOW) >> U64(32))
        places.append(place[at].astype(U64))
        docs.append(ids[a:b][row[at]])
        of.append(tags[a:b][row[at]])
    if not first:
        return
    h1, h2, at, doc, tag = map(np.concatenate, (first, second, places, docs, of))
    later, _ = _later(np.stack([h1, h2]), doc, at)
    own = mix(doc.view(U64) + mix(at))
    h1, h2 = np.where(later, own, h1), np.where(later, own & U64(0xFFFFFFFF), h2)
    yield pa.RecordBatch.from_arrays(
        [_signed(h1), _signed((h2 << U64(32)) | (later.astype(U64) << U64(31)) | at), pa.array(doc), pa.array(tag)],
        ["h1", "hp", "doc_id", "tag"])


def _cut(untouched: bool):
    """Words that are left. Columns in: id, text, copy, starts of windows, further ones, which are handed on."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        copies, starts = np.asarray(batch.column(2)), batch.column(3)
        counts, removed, kept = [], [], []
        for i, text in enumerate(text_bytes(batch.column(1))):
            words = text.tobytes().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if starts[i].is_valid:
                at = np.asarray(starts[i].values)
                at = at[at + WINDOW <= len(words)]
                np.add.at(gone, at, 1)
                np.subtract.at(gone, at + WINDOW, 1)
            left = np.cumsum(gone)[:-1] == 0
            if copies[i] and len(words) >= WINDOW:
                left[:] = False
            counts.append(len(words))
            removed.append(int(len(words) - left.sum()))
            if untouched and not removed[-1]:
                kept.append(text.tobytes().decode())
            else:
                kept.append(b" ".join(words if left.all() else [w for w, ok in zip(words, left) if ok]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
             *batch.columns[4:]], ["doc_id", "n_words", "n_removed", "kept_text", *batch.schema.names[4:]])

    return step


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                   untouched: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, and the columns ``keep``) per row.

    The kept words are joined by one blank; with ``untouched`` a text that loses nothing stays as it is.
    """
    more = [f"__{i}" for i in range(len(keep))]
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                        *[F.col(f"`{c}`").alias(m) for c, m in zip(keep, more)])
    named = plain.filter(F.col("doc_id").isNotNull()).withColumn("hash", F.xxhash64("text"))
    numbered = numbering(named)
    # The three joins with the texts are on this one shuffle: the same columns, so that the exchange is reused.
    by_doc = numbered(named.repartition("doc_id")).select("doc_id", "text", "tag", *more)
    prints = materialise(numbered(map_batches(named.select("doc_id", "text", "hash"), "doc_id long, hash long, n_words long, f1 long, f2 long",
                                              _fingerprints)), "prints")
    # Documents whose word sequence an earlier document has. Groups are reduced before they meet their members.
    groups = (prints.filter(F.col("n_words") >= WINDOW).groupBy("f1", "f2")
              .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    copies = (prints.join(groups, ["f1", "f2"]).filter(F.col("doc_id") > F.col("first"))
              .select(F.col("doc_id").alias("id"), F.col("tag").alias("of")).distinct().withColumn("copy", F.lit(True)))
    copies = materialise(copies, "copies")

    this_text = (F.col("doc_id") == F.col("id")) & same("tag", "of")
    marked = by_doc.join(copies, this_text, "left").drop("id", "of")
    anchors = map_batches(marked.filter(F.col("copy").isNull()).select("doc_id", "text", *more), "key long, doc_id long", _anchors)
    # Dealt by the expression itself: a column for it would travel with every row.
    anchors = anchors.repartition(F.shiftrightunsigned("key", 17))
    by_hash = Window.partitionBy(F.shiftrightunsigned("key", 17)).orderBy("doc_id")
    repeated = (
        anchors.select("key", "doc_id", F.lag("key").over(by_hash).alias("before"),
                       F.lead("key").over(by_hash).alias("after"))
        .filter((F.col("key").bitwiseAND(F.lit(KNOWN)) != 0) | F.col("before").isNotNull() | F.col("after").isNotNull())
        .groupBy("doc_id").agg(F.collect_set(F.col("key").bitwiseAND(F.lit(LAST_PLACE)).cast("int")).alias("anchors"))
    )
    windows = map_batches(by_doc.join(repeated, "doc_id").select("doc_id", "text", "anchors", "tag", *more),
                          "h1 long, hp long, doc_id long, tag int", _windows).repartition("h1")
    among_equal = Window.partitionBy("h1", F.shiftrightunsigned("hp", 32)).orderBy("doc_id", "place")
    later = (
        windows.withColumn("place", F.col("hp").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
        .withColumn("rank", F.rank().over(among_equal))
        .filter((F.col("hp").bitwiseAND(F.lit(0x80000000)) != 0) | (F.col("rank") > 1))
        .groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("of")).agg(F.collect_set("place").alias("starts"))
    )
    kinds = dict(docs.dtypes)
    result = ", ".join(["doc_id long, n_words long, n_removed long, kept_text string",
                        *(f"`{m}` {kinds[c]}" for c, m in zip(keep, more))])
    unnamed = plain.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("starts"), *more)
    return map_batches(
        marked.join(later, this_text, "left")
        .select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts", *more),
        result, _cut(untouched),
    ).union(map_batches(unnamed, result, _cut(untouched))).toDF("doc_id", "n_words", "n_removed", "kept_text", *keep)
