"""Maximal runs of repeated words by grammar compression: each phrase of the grammar is searched once.

1. In a run of at least 24 words and three periods every word lies in eight consecutive words that come again in the
   document. Only such stretches go on; they hold all runs.
2. Re-Pair: in rounds, pairs of neighbouring symbols that occur twice or more become a new symbol wherever they have the
   highest count among the pairs that overlap them, until no pair occurs twice. One grammar serves the texts of a
   step, so a passage that many of them share is one symbol.
3. A run either lies in a phrase, and then crosses the boundary between the halves of the lowest phrase that holds it, or it
   crosses a boundary of the remaining sequence. So each boundary is searched once for the runs that cross it (in
   phrases only those that fit the shortest allowed run). One side of a run of period q >= 16 is at least 1.5 q long, so the 2^j
   words next to the boundary, 2^j <= q / 2, come again q words further on; smaller periods are all tried.
4. Runs of a phrase are translated to all places where it was derived; overlapping intervals of the same period merge, and of equal
   intervals the smallest period stays.

Everything happens within a row of the table, in steps of about one megabyte of text: no shuffle. Null texts have no words. A
null id gets no planted period. Equal rows get equal results. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.llm.common import Rolling, local_index, map_batches, mix, steps, text_bytes, words_of

LEAST = 24  # words in a run
TIMES = 3  # periods in a run
GRAM = 8
SMALL = 2 * GRAM  # periods below are tried at every boundary
CANDIDATES = 1 << 20  # that are compared at a time

_GRAMS = Rolling(0xBF58476D1CE4E5B9)

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, periods


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the original words that a document gets in place of its own; None if it stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def dense(values: np.ndarray) -> np.ndarray:
    """Ranks of the values among the distinct ones."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(values) else order
    return out


def stretches(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches whose words lie in eight words that come again in their document."""
    row, place, size = local_index(firsts)
    at = np.flatnonzero(place + GRAM <= size)
    hashes = mix(_GRAMS.spans(words, at, at + GRAM) + mix(row[at].astype(np.uint64)))
    ordered = np.sort(hashes)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = at[again[np.minimum(np.searchsorted(again, hashes), len(again) - 1)] == hashes]
    # Within a document neighbouring windows overlap or touch; documents are kept apart by the row.
    new = np.concatenate([[True], (held[1:] > held[:-1] + GRAM) | (row[held[1:]] != row[held[:-1]])])
    ends = np.append(held[np.flatnonzero(new)[1:] - 1], held[-1]) + GRAM
    starts = held[new]
    long_enough = ends - starts >= LEAST
    return starts[long_enough], ends[long_enough]


class Grammar:
    """Re-Pair over non-negative symbols; negative ones are never paired.

    ``places`` of what is left, and for each rule its halves (``cut`` is the length of the first), its length and all places
    where it was derived.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        s, at = symbols.astype(np.int64), np.arange(len(symbols))
        top = int(s.max(initial=0)) + 1
        length = np.ones(top, np.int64)
        cuts, lengths, rules, where = [], [], [], []
        n_rules = 0
        while len(s) > 1:
            joint = np.where((s[:-1] >= 0) & (s[1:] >= 0), s[:-1] * top + s[1:], -1)
            kinds, kind, count = np.unique(joint, return_inverse=True, return_counts=True)
            rank = np.empty(len(kinds), np.int64)
            rank[np.lexsort((kinds, count))] = np.arange(1, len(kinds) + 1)
            rank[(count < 2) | (kinds < 0)] = 0
            r = rank[kind]
            before, after = np.concatenate([[0], r[:-1]]), np.concatenate([r[1:], [0]])
            begins = np.maximum.accumulate(np.where(r != before, np.arange(len(r)), 0))
            chosen = np.flatnonzero((r > 0) & (r >= before) & (r >= after) & ((np.arange(len(r)) - begins) % 2 == 0))
            if not len(chosen):
                break
            used, rule = np.unique(kind[chosen], return_inverse=True)
            left, right = kinds[used] // top, kinds[used] % top
            cuts.append(length[left])
            lengths.append(length[left] + length[right])
            rules.append(rule + n_rules)
            where.append(at[chosen])
            s[chosen] = top + rule
            n_rules += len(used)
            top += len(used)
            length = np.concatenate([length, lengths[-1]])
            stays = np.ones(len(s), bool)
            stays[chosen + 1] = False
            s, at = s[stays], at[stays]
        whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        self.symbols, self.places = s, at
        self.cut, self.length = whole(cuts), whole(lengths)
        self.rule, self.where = whole(rules), whole(where)


class Alike:
    """Ranks of all stretches of 2^k symbols, and from them common extensions, exactly."""

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        self.size, self.ranks = len(symbols), [dense(symbols)]
        while 2 << (len(self.ranks) - 1) <= longest:
            k, last = 1 << (len(self.ranks) - 1), self.ranks[-1]
            # Beyond the end nothing is alike: a rank of its own for each place.
            further = np.concatenate([last[k:], self.size + np.arange(min(k, self.size))])
            self.ranks.append(dense(last * (2 * self.size + 1) + further))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from the places a and b on."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + out, b + out
            inside = np.maximum(x, y) < self.size
            same = inside & (self.ranks[k][np.where(inside, x, 0)] == self.ranks[k][np.where(inside, y, 0)])
            out += same.astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols before the places a and b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - out - (1 << k), b - out - (1 << k)
            inside = np.minimum(x, y) >= 0
            same = inside & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)])
            out += same.astype(np.int64) << k
        return out


def crossing(alike: Alike, boundary: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, Spans]:
    """Runs in [low, high) that hold the symbols on both sides of ``boundary``: (number of the boundary, spans)."""
    numbers: list[np.ndarray] = []
    found: list[Spans] = []

    def test(i: np.ndarray, anchor: np.ndarray, q: np.ndarray) -> None:
        for a in range(0, len(i), CANDIDATES):
            j, c, p = i[a: a + CANDIDATES], anchor[a: a + CANDIDATES], q[a: a + CANDIDATES]
            end = np.minimum(c + p + alike.forward(c, c + p), high[j])
            start = np.maximum(c - alike.backward(c, c + p), low[j])
            good = (start < boundary[j]) & (end > boundary[j]) & (end - start >= np.maximum(LEAST, TIMES * p))
            numbers.append(j[good])
            found.append((start[good], end[good], p[good]))

    every = np.arange(len(boundary))
    for q in range(1, SMALL):
        fits = every[high - low >= TIMES * q]
        ahead, behind = fits[boundary[fits] + q < high[fits]], fits[boundary[fits] - q >= low[fits]]
        test(ahead, boundary[ahead], np.full(len(ahead), q))
        test(behind, boundary[behind] - q, np.full(len(behind), q))
    for k in range(GRAM.bit_length() - 1, len(alike.ranks)):
        gram, q = 1 << k, 2 << k
        fits = every[high - low >= TIMES * q]
        if not len(fits):
            break
        rank = alike.ranks[k]
        order = np.argsort(rank, kind="stable")
        places = rank[order] * alike.size + order
        for ahead in (True, False):
            use = fits[boundary[fits] + gram <= high[fits]] if ahead else fits[boundary[fits] - gram >= low[fits]]
            at = boundary[use] if ahead else boundary[use] - gram
            first, last = (at + q, at + 2 * q) if ahead else (at - 2 * q + 1, at - q + 1)
            first, last = np.maximum(first, low[use]), np.minimum(last, high[use])
            base = rank[at] * alike.size
            a, b = np.searchsorted(places, base + first), np.searchsorted(places, base + np.maximum(first, last))
            n = b - a
            i = np.repeat(np.arange(len(use)), n)
            other = order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
            period = np.abs(other - at[i])
            test(use[i], boundary[use[i]] - (0 if ahead else period), period)
    spans = tuple(np.concatenate([np.zeros(0, np.int64), *(f[x] for f in found)]) for x in range(3))
    return np.concatenate([np.zeros(0, np.int64), *numbers]), spans


def maximal(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> Spans:
    """Merge overlapping spans of the same period; of equal spans keep the smallest period. By start, then period."""

    def smallest(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> Spans:
        order = np.lexsort((q, e, s))
        s, e, q = s[order], e[order], q[order]
        keep = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[: len(s)]
        return s[keep], e[keep], q[keep]

    s, e, q = smallest(starts, ends, periods)
    if not len(s):
        return s, e, q
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    group = np.concatenate([[0], np.cumsum(q[1:] != q[:-1])])
    wide = int(e.max()) + 1
    reach = np.maximum.accumulate(e + group * wide) - group * wide
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (s[1:] > reach[:-1] - q[1:])])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    s, e, q = smallest(s[new], reach[last], q[new])
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def runs(words: np.ndarray, firsts: np.ndarray) -> Spans:
    """All runs of all documents whose word hashes lie side by side, as places in ``words``."""
    starts, ends = stretches(words, firsts)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    # The stretches side by side, each followed by a symbol of its own.
    sizes = ends - starts + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.repeat(starts - begins[:-1], sizes) + np.arange(begins[-1])
    parting = np.zeros(begins[-1], bool)
    parting[begins[1:] - 1] = True
    symbols = dense(words[np.where(parting, 0, inside)])
    symbols[parting] = -1 - np.arange(len(starts))
    grammar = Grammar(symbols)
    alike = Alike(symbols, int(sizes.max()))

    # Phrases by one of their places, and the boundaries of what is left.
    rules, seen = np.unique(grammar.rule, return_index=True)
    at, long_enough = grammar.where[seen], grammar.length[rules] >= LEAST
    rules, at = rules[long_enough], at[long_enough]
    between = np.flatnonzero((grammar.symbols[:-1] >= 0) & (grammar.symbols[1:] >= 0))
    open_at = grammar.places[between + 1]
    stretch = np.searchsorted(begins, open_at, side="right") - 1
    boundary = np.concatenate([at + grammar.cut[rules], open_at])
    low = np.concatenate([at, begins[stretch]])
    high = np.concatenate([at + grammar.length[rules], begins[stretch + 1] - 1])
    number, (s, e, q) = crossing(alike, boundary, low, high)

    of_rule = number < len(rules)
    rule, shift = rules[number[of_rule]], at[number[of_rule]]
    order = np.argsort(grammar.rule, kind="stable")
    first = np.searchsorted(grammar.rule[order], rule)
    n = np.searchsorted(grammar.rule[order], rule, side="right") - first
    i = np.repeat(np.arange(len(rule)), n)
    derived = grammar.where[order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] - shift[i]
    s = np.concatenate([s[of_rule][i] + derived, s[~of_rule]])
    e = np.concatenate([e[of_rule][i] + derived, e[~of_rule]])
    q = np.concatenate([q[of_rule][i], q[~of_rule]])
    s, e, q = maximal(s, e, q)
    moved = (starts - begins[:-1])[np.searchsorted(begins, s, side="right") - 1]
    return s + moved, e + moved, q


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The (start, length, period) of greatest length / period; ties to the smallest start, then period."""
    best = found[0]
    for run in found[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
    out: list[tuple] = []
    for a, b in steps([len(t) for t in texts]):
        hashes, firsts = words_of(texts[a:b])
        turned = [planted(ids[a + i], int(firsts[i + 1] - firsts[i])) for i in range(b - a)]
        for i, at in enumerate(turned):
            if at is not None:
                own = hashes[firsts[i]: firsts[i + 1]]
                own[:] = own[at]
        s, e, q = runs(hashes, firsts)
        bounds = np.searchsorted(s, firsts)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            words = texts[a + i].tobytes().split()
            if turned[i] is not None:
                words = [words[j] for j in turned[i].tolist()]
            found = list(zip((s[lo:hi] - firsts[i]).tolist(), (e[lo:hi] - s[lo:hi]).tolist(), q[lo:hi].tolist()))
            row: tuple = (ids[a + i], len(found), None, None, None, None)
            if found:
                left = np.ones(len(words), bool)
                for start, length, period in found:
                    left[start + period: start + length] = False
                words = [words[j] for j in np.flatnonzero(left).tolist()]
                start, length, period = strongest(found)
                row = (ids[a + i], len(found), start, length, period, 1000 * length // period)
            listed = "".join(f"{x},{y},{z}\n" for x, y, z in found)
            out.append((*row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], NAMES)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of runs, the strongest one, and digests of all runs and of the text without their repetitions."""
    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), RESULT, _step)
