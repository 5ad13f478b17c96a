"""Helpers shared by the corpus operators: reading, words as bytes, folder for written tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granthi.session import materialise

# Words of the contracts: runs of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text that one step of a task holds in numpy at a time (a longer text is a step of its own).
STEP_BYTES = 1 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def same(left: str, right: str) -> Column:
    """Equality that the planner does not take for a join key, so that a join stays on the shuffle by document."""
    return F.col(left).bitwiseXOR(F.col(right)) == 0


def numbering(hashed: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """From (doc_id, hash of the text): what adds ``tag``, the number of a text among the different texts of its id, to such rows.

    All texts but the first of an id, which are few or none, are written as a table.
    """
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")) - 1
    others = materialise(hashed.select("doc_id", "hash").distinct().withColumn("tag", number).filter("tag > 0").toDF("id", "of", "tag"), "others")

    def numbered(rows: DataFrame) -> DataFrame:
        joined = rows.join(others, (F.col("doc_id") == F.col("id")) & same("hash", "of"), "left")
        return joined.withColumn("tag", F.coalesce("tag", F.lit(0))).drop("id", "of")

    return numbered


def spaces() -> np.ndarray:
    """True for the bytes that part words."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, base, U64)]))


class Rolling:
    """Hashes of all windows of ``n`` consecutive 64-bit values by one pass of prefix sums."""

    def __init__(self, base: int) -> None:
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = powers(self.base, 1)
        self.down = powers(self.inverse, 1)

    def _grow(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = powers(self.base, 2 * n), powers(self.inverse, 2 * n)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], independent of where the span lies."""
        self._grow(len(values) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(values * self.up[: len(values)], dtype=U64)])
            return mix((total[ends] - total[starts]) * self.down[starts])


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))
_SPACES = spaces()
_BYTES = Rolling(0x9E3779B97F4A7C15)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes. The parting bytes never occur inside a longer code."""
    edge = np.diff(np.concatenate([[True], _SPACES[data], [True]]).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(_BYTES.spans(_BYTE_VALUES[data], starts, ends) + (ends - starts).astype(U64))


def text_bytes(text: pa.Array) -> list[np.ndarray]:
    """UTF-8 bytes of each text without a copy; null is empty."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    valid = np.asarray(text.is_valid())
    return [data[a:b] if ok else data[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to about ``limit``; one larger row is a range of its own."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what one job leaves would add to the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``step`` over each Arrow batch, in place: no shuffle, nothing kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        give_back()

    return df.mapInArrow(run, schema)


def words_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and where each text's words begin (one more than texts)."""
    blank = np.array([0x20], np.uint8)
    data = np.concatenate([part for t in texts for part in (t, blank)]) if texts else np.zeros(0, np.uint8)
    starts, ends = word_spans(data)
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    return word_hashes(data, starts, ends), firsts.astype(np.int64)


def local_index(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its text, its place in the text, and the number of words of the text."""
    counts = np.diff(firsts)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(firsts[-1]) - firsts[row], counts[row]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, and where each group begins, from rows sorted by integer ``keys``.

    Holds one batch and the rows of the group that is still open.
    """

    def cuts(rows: pa.Table) -> np.ndarray:
        values = np.stack([np.asarray(rows.column(k).combine_chunks()) for k in keys])
        return np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1])

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        held.append(batch)
        if last == ends and tuple(batch.column(k)[0].as_py() for k in keys) == ends:
            continue  # still the same group
        last = ends
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = cuts(rows)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
        held = rows.slice(starts[-1]).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, cuts(rows)
    give_back()


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(dtype, copy=False).reshape(len(column), -1)


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
