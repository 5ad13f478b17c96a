"""Periodic runs against a quadratic search, and the grammar against its own expansion."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from granthi.llm import periodic_runs as pr


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    ids = np.unique(np.array(words), return_inverse=True)[1] if n else np.zeros(0, int)
    spans = {}
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(np.int8)
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + q >= max(24, 3 * q):
                spans.setdefault((int(a), int(b - a + q)), q)
    runs = sorted((s, length, q) for (s, length), q in spans.items())
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def texts():
    g = random.Random(12)
    out = [None, "", " \n ", "a", "a " * 23, "a " * 24, "ab " * 500, "a b " * 40 + "a", "x " + "a b c " * 8 + "a y", "a b " * 30]
    for _ in range(150):
        letters = "abcdefghij"[: g.randint(1, 10)]
        parts = []
        for _ in range(g.randint(1, 6)):
            block = [g.choice(letters) for _ in range(g.randint(1, 60))]
            whole = block * g.randint(1, 6) + block[: g.randint(0, len(block))]
            if g.random() < 0.4:
                whole[g.randrange(len(whole))] = "z"
            parts += whole
        out.append(" ".join(parts))
    for _ in range(40):  # runs of runs
        inner = ["a", "b"] * g.randint(1, 20)
        out.append(" ".join((inner + ["c"] * g.randint(1, 3)) * g.randint(2, 6)))
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 700:
        thue += thue.translate(str.maketrans("ab", "ba"))
    return [*out, " ".join(fib[-1]), " ".join(thue), " ".join(thue * 3), " ".join(g.choice("ab") for _ in range(3000))]


def test_runs_equal_brute_force(spark):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts())] + [(7, "a b c " * 30)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS period", "2 AS n_runs")
    for parts in (1, 5):
        got = pr.find_runs(frame.repartition(parts)).collect()
        order = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got), key=order) == sorted((brute(*r) for r in rows), key=order)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in entry.queries()["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text or "") < 60_000:
            assert got[d.doc_id] == brute(d.doc_id, d.text)
    assert sum(r[1] > 0 for r in got.values()) >= 10


def test_empty_table(spark):
    assert pr.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_grammar_derives_its_input(seed):
    g = np.random.default_rng(seed)
    s = np.concatenate([np.tile(g.integers(0, 5, g.integers(1, 9)), 7), g.integers(0, 5, 40), [-1], g.integers(0, 3, 60), [-2]])
    grammar = pr.Grammar(s)
    ends = {p: p + 1 for p in range(len(s))}
    for rule, at in zip(grammar.rule, grammar.where):
        assert ends[at] == at + grammar.cut[rule]
        ends[at] = ends[ends[at]]
        assert ends[at] == at + grammar.length[rule]
        first = grammar.where[np.flatnonzero(grammar.rule == rule)[0]]
        assert (s[at: ends[at]] == s[first: first + grammar.length[rule]]).all() and (s[at: ends[at]] >= 0).all()
    assert sorted(ends[p] for p in grammar.places) == sorted([*grammar.places[1:], len(s)])
    pairs = [(a, b) for a, b in zip(grammar.symbols, grammar.symbols[1:]) if a >= 0 and b >= 0]
    assert len(grammar.symbols) < len(s) and len({p for p in pairs if pairs.count(p) > 1}) == 0
