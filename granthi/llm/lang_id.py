"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters is one boundary sign. Features are the n-grams of one to three
signs that touch a letter (longer ones only with letters inside), hashed to ``BUCKETS`` columns.
Counts for training are summed in the tasks, so only (language, bucket) sums are shuffled. The matrix of log
probabilities has languages x buckets entries, goes to the workers once, and a batch of texts is scored as a sparse
matrix: the rows of the matrix at the buckets that occur are summed up per text. Texts are read whole, in
slices of ``SLICE`` characters.

Null texts and texts without a letter give ``und`` with score 0, as does everything when nothing was learned.
Of languages with equal scores the first by code point wins. Rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthi.llm.common import U64, map_batches, steps
from granthi.session import broadcast_if_small

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SLICE = 1 << 18
UNDETERMINED = "und"
# Documents per language that the classifier is fitted on (all, if fewer): hash-chosen, so the same ones in a rerun.
SAMPLE_PER_LANGUAGE = 4000

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


def signs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each ended by a boundary, other signs than letters as 0; the starts."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])[:-1]]).astype(np.int64)
    return np.where(letters()[codes], codes, np.uint32(0)), starts


def features(codes: np.ndarray, begin: int, end: int) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that ends at each position of a slice; BUCKETS: not a feature."""
    for order in ORDERS:
        window = codes[max(0, begin - order + 1): end].astype(U64)
        if len(window) < end - begin + order - 1:  # before the first text there are boundaries
            window = np.concatenate([np.zeros(end - begin + order - 1 - len(window), U64), window])
        parts = [window[i: i + end - begin] for i in range(order)]
        hashed = np.full(end - begin, order, U64)
        with np.errstate(over="ignore"):
            for part in parts:
                hashed = (hashed * U64(0x9E3779B97F4A7C15)) ^ part
                hashed ^= hashed >> U64(29)
            bucket = ((hashed * U64(0xBF58476D1CE4E5B9)) >> U64(64 - BITS)).astype(np.int64)
        inside = parts if order == 1 else parts[1:-1]
        held = np.logical_and.reduce([p != 0 for p in inside]) if inside else (parts[0] != 0) | (parts[1] != 0)
        yield np.where(held, bucket, BUCKETS)


def slices(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    for begin in range(0, len(codes), SLICE):
        yield begin, min(begin + SLICE, len(codes))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1) x languages; the last row is 0
    prior: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Joint log probability of each text with each language."""
        codes, starts = signs(texts)
        out = np.tile(self.prior, (len(texts), 1))
        for begin, end in slices(codes):
            first = np.searchsorted(starts, begin, "right") - 1
            last = np.searchsorted(starts, end, "left")
            cuts = np.maximum(starts[first:last], begin) - begin
            for bucket in features(codes, begin, end):
                out[first:last] += np.add.reduceat(self.table[bucket], cuts, axis=0)
        return out


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", key: str = "doc_id",
        per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and ``lang`` is known, at most about ``per_language`` of each.

    Class priors come from all those rows. Only ``lang``, ``text`` and the key (for the choice) are read.
    """
    known = docs.filter(learn & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["lang"]: r["n"] for r in sizes.collect()}  # one row per language
    chosen = known.join(broadcast_if_small(sizes), "lang").filter(
        F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * per_language / F.col("n"))
    sums = (chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    languages = sorted(totals)
    counts = np.zeros((BUCKETS, len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    columns = np.array([place[name] for name in sums.column("lang").to_pylist()], np.int64)
    counts[np.asarray(sums.column("bucket")), columns] = np.asarray(sums.column("n"))
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    whole = sum(totals.values())
    prior = np.array([math.log(totals[name] / whole) for name in languages])
    return LanguageModel(languages, np.vstack([logs, np.zeros((1, len(languages)))]).astype(np.float32), prior)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a whole task by language and bucket."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for name in set(names):
            own = [texts[i] for i in np.flatnonzero(names == name)]
            total = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
            for a, b in steps([len(t or "") for t in own]):
                codes, _ = signs(own[a:b])
                for begin, end in slices(codes):
                    for bucket in features(codes, begin, end):
                        total += np.bincount(bucket, minlength=BUCKETS + 1)
    for name, total in sums.items():
        held = np.flatnonzero(total[:BUCKETS])
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(total[held], pa.int64())],
            ["lang", "bucket", "n"])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``, the posterior probability of that language. Map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        texts = batch.column(batch.num_columns - 1).to_pylist()
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for a, b in steps([len(t or "") for t in texts]) if learned.languages else ():
            joint = learned.scores(texts[a:b])
            best = joint.argmax(axis=1)
            posterior = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
            for i in range(a, b):
                if any(map(str.isalpha, texts[i] or "")):
                    names[i], scores[i] = learned.languages[best[i - a]], posterior[i - a]
        arrays = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    # The text comes last under a name of its own, so that it may also be among the kept columns.
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    return map_batches(rows, schema, step)
