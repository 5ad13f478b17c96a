"""Counts behind the line gate, for many lines at a time as arrays of code points.

The lines of an Arrow batch are laid out one after another, a blank behind each, and every count is a few passes of numpy over that
text: the cost grows with the characters, not with characters times counts. Slabs bound what is held beside a batch; a line longer than
a slab is a slab of its own. Tokens are maximal runs of letters, digits, underscores or Devanagari.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granthi import lexicons as lx

# Functions that run in Python workers travel with the task: workers need no package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLAB_BYTES = 1 << 19
FIELDS = ("chars", "dev", "lat", "n", "stop", "vowelled", "judged", "novowel", "caps", "exotic",
          "dn", "fused", "intrusions", "singles", "runs", "orphans", "longest")
COUNTS = T.StructType([T.StructField(f, T.IntegerType()) for f in FIELDS])

TOKEN, ASCII_LETTER, LATIN, VOWEL, ROMAN, DEV, COMBINING, CONSONANT, INTRUDER, EXOTIC, LOWER, UPPER = (
    1 << i for i in range(12))
CODES = 0x110000
SMALL = "abcdefghijklmnopqrstuvwxyz"
DOTTED_I, KELVIN = 0x130, 0x212A  # the only other characters whose lower case holds a letter from a to z
STOPWORDS = lx.GATE_STOPWORDS


@lru_cache(maxsize=1)
def _category_runs() -> tuple[np.ndarray, np.ndarray]:
    """Letters (2), numbers (1) and the rest (0) of Unicode as stretches: where each begins, and which it is."""
    kinds = np.fromiter(({"L": 2, "N": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(CODES)), np.uint8, CODES)
    began = np.flatnonzero(np.diff(kinds, prepend=255))
    return began, kinds[began]


def _tables(began: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Flags per code point, the place in the alphabet of its lower case, the stop words as numbers and their greatest length."""
    flags = np.repeat(np.array([0, TOKEN, TOKEN | EXOTIC], np.uint16)[kinds], np.diff(np.append(began, CODES)))

    def mark(flag: int, chars: str) -> None:
        flags[[ord(c) for c in chars]] |= np.uint16(flag)

    flags[[ord(c) for c in SMALL + SMALL.upper()]] = TOKEN
    flags[0x900:0x980] = TOKEN | DEV
    mark(TOKEN, "_")
    mark(LOWER, SMALL)
    mark(UPPER, SMALL.upper())
    mark(ASCII_LETTER | LATIN | INTRUDER, SMALL + SMALL.upper())
    mark(VOWEL, "aeiouyAEIOUY")
    mark(ROMAN, "ivxlcdmIVXLCDM")
    mark(INTRUDER, "[]\\/{}<>@#$%^&*|~`")
    mark(LATIN | VOWEL, chr(DOTTED_I))
    mark(LATIN, chr(KELVIN))
    for first, last in ((0x93A, 0x94F), (0x951, 0x957), (0x962, 0x963)):
        flags[first:last + 1] |= COMBINING
    for first, last in ((0x915, 0x939), (0x958, 0x95F), (0x978, 0x97F)):
        flags[first:last + 1] |= CONSONANT
    place = np.zeros(CODES, np.uint8)
    for i, c in enumerate(SMALL, 1):
        place[[ord(c), ord(c.upper())]] = i
    place[KELVIN] = place[ord("k")]
    longest = max(map(len, STOPWORDS))
    words = np.zeros((len(STOPWORDS), longest), np.int64)
    for i, word in enumerate(STOPWORDS):
        words[i, :len(word)] = [place[ord(c)] for c in word]
    return flags, place, _packed(words, 27), longest


def _packed(digits: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(digits), np.int64)
    for column in digits.T:
        out = out * base + column
    return out


def _heads(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` codes of each token, 0 beyond its end."""
    steps = np.arange(width)
    at = np.minimum(starts[:, None] + steps, len(codes) - 1)
    return np.where(steps < lengths[:, None], codes[at], 0).astype(np.int64)


def _counts(lines: list[str], tables: tuple) -> dict[str, np.ndarray]:
    """The counts of some lines, each an array with one number per line."""
    table, place, stopwords, stop_length = tables
    text = " ".join(lines) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.fromiter(map(len, lines), np.int64, len(lines))
    edges = np.concatenate([[0], np.cumsum(chars + 1)])
    flags = table[codes]

    def per_line(at: np.ndarray) -> np.ndarray:
        """How many of these sorted positions lie in each line."""
        return np.diff(np.searchsorted(at, edges))

    def where(held: np.ndarray) -> np.ndarray:
        return per_line(np.flatnonzero(held))

    def has(flag: int) -> np.ndarray:
        return (flags & flag) != 0

    token = has(TOKEN)
    turns = np.flatnonzero(np.diff(token, prepend=False))  # the text ends with a blank, so starts and ends alternate
    starts, ends = turns[::2], turns[1::2]
    any_of = np.bitwise_or.reduceat(flags, turns)[::2] if len(turns) else flags[:0]
    all_of = np.bitwise_and.reduceat(flags, turns)[::2] if len(turns) else flags[:0]
    lengths = ends - starts
    lowered = lengths
    if (codes == DOTTED_I).any():  # two characters in lower case
        dots = np.flatnonzero(codes == DOTTED_I)
        lowered = lengths + np.searchsorted(dots, ends) - np.searchsorted(dots, starts)

    def tokens(held: np.ndarray) -> np.ndarray:
        return per_line(starts[held])

    latin, vowel = (any_of & LATIN) != 0, (any_of & VOWEL) != 0
    long = lowered >= 3
    roman = ((all_of & ROMAN) != 0) & long
    # Of the characters that count as Latin only the dotted capital has no place in the alphabet, and its lower case is longer.
    words = np.flatnonzero(((all_of & LATIN) != 0) & (lengths <= stop_length) & (lowered == lengths))
    spelled = np.isin(_packed(place[_heads(codes, starts[words], lengths[words], stop_length)], 27), stopwords)
    camel = np.flatnonzero(((flags[:-1] & LOWER) != 0) & ((flags[1:] & UPPER) != 0))
    camel = np.unique(np.searchsorted(starts, camel, "right") - 1)
    held = {
        "chars": chars, "lat": where(has(ASCII_LETTER)), "n": tokens(latin), "vowelled": tokens(vowel),
        "stop": np.minimum(per_line(starts[words[spelled]]), 1), "judged": tokens(latin & long & ~roman),
        "novowel": tokens(latin & long & ~roman & ~vowel),
        "caps": per_line(starts[camel]), "exotic": where(has(EXOTIC)),
    }
    dev = has(DEV)
    if not dev.any():
        none = np.zeros(len(lines), np.int64)
        return held | {f: none for f in FIELDS if f not in held}
    before = np.concatenate([[0], flags[:-1]])
    runs_of_marks = has(COMBINING) & ((before & (COMBINING | CONSONANT)) == 0)
    middle = np.flatnonzero(dev[:-2] & has(INTRUDER)[1:-1] & dev[2:])
    # Matches do not overlap: of neighbours that share a character every second one counts.
    chain = np.diff(middle, prepend=-9) != 2
    place_in_chain = np.arange(len(middle)) - np.maximum.accumulate(np.where(chain, np.arange(len(middle)), 0))
    ours = np.flatnonzero((any_of & DEV) != 0)
    at, size = starts[ours], lengths[ours]
    line = np.searchsorted(edges, at, "right") - 1
    heads = _heads(codes, at, size, 4)
    first, fourth = _packed(heads[:, :3], 1 << 21), heads[:, 3]
    alike = np.flatnonzero((first[1:] == first[:-1]) & (fourth[1:] == fourth[:-1]) & (size[1:] == size[:-1])
                           & (line[1:] == line[:-1]) & (size[1:] > 1))
    same = [i for i in alike if size[i] <= 4 or text[at[i]:at[i] + size[i]] == text[at[i + 1]:at[i + 1] + size[i]]]
    few = np.flatnonzero((size >= 2) & (size <= 4))
    few = few[np.lexsort((fourth[few], first[few], line[few]))]
    longest = np.zeros(len(lines), np.int64)
    if len(few):
        new = np.concatenate([[True], (np.diff(first[few]) != 0) | (np.diff(fourth[few]) != 0) | (np.diff(line[few]) != 0)])
        began = np.flatnonzero(new)
        np.maximum.at(longest, line[few[began]], np.diff(np.append(began, len(few))))
    return held | {
        "dev": where(dev), "dn": per_line(at), "fused": per_line(at[(any_of[ours] & ASCII_LETTER) != 0]),
        "intrusions": per_line(middle[place_in_chain % 2 == 0]), "singles": per_line(at[size == 1]),
        "runs": per_line(at[np.array(same, dtype=np.int64)]), "orphans": where(runs_of_marks), "longest": longest,
    }


def _counted(lines: pa.Array, tables: tuple) -> pa.StructArray:
    """One struct of counts per line; null for a null line."""
    sizes = pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
    slab = np.cumsum(sizes, dtype=np.int64) // SLAB_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(slab)) + 1).tolist(), len(lines)]
    parts = [_counts([s or "" for s in lines.slice(a, b - a).to_pylist()], tables) for a, b in zip(cuts, cuts[1:]) if b > a]
    columns = [pa.array(np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, np.int64), pa.int32()) for f in FIELDS]
    return pa.StructArray.from_arrays(columns, names=list(FIELDS), mask=pc.is_null(lines))


def counts_of_line(line: Column) -> Column:
    """The counts of a string column."""
    runs, made = _category_runs(), []

    @F.arrow_udf(COUNTS)
    def counted(lines: pa.Array) -> pa.Array:
        if not made:
            made.append(_tables(*runs))
        return _counted(lines, made[0])

    return counted(line)


def counts_of_lines(lines: Column) -> Column:
    """The counts of every line of an array column."""
    runs, made = _category_runs(), []

    @F.arrow_udf(T.ArrayType(COUNTS))
    def counted(lists: pa.Array) -> pa.Array:
        if not made:
            made.append(_tables(*runs))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, _counted(lists.flatten(), made[0]), mask=pc.is_null(lists))

    return counted(lines)
