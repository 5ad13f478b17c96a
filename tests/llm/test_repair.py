"""Conversation repair against a plain dynamic program over strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from granthi.llm import conversation_repair as cr

NEXT, KEEPS = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string"


def inserted(best):
    for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if a in best:
            cost, audit, lines = best[a]
            new = (cost + 5, audit + "I", lines + [f"{cr.ROLE[b]}:"])
            best[b] = min(best.get(b, new), new, key=lambda x: x[:2])
    return best


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        by[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, n, best = set(), [0, 0, 0], {0: (0, "", [])}
        for _, role, text in own:
            blank, repeated = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            seen.add((role, text))
            late = not blank and not repeated and re.search(r"[^\x20\x09-\x0D]", text[::-1]).group() not in ".!?"
            n = [n[0] + blank, n[1] + (not blank and repeated), n[2] + late]
            best, new = inserted(best), {}
            for q, (cost, audit, lines) in best.items():
                ways = [(q, cost + 2, "D", [])]
                if not blank and not repeated:
                    ways.append((NEXT[q], cost + 1 + 5 * late, "R", [f"{cr.ROLE[NEXT[q]]}:{text}"]))
                    if (q, role[:1]) in KEEPS:
                        ways.append((KEEPS[q, role[:1]], cost + 5 * late, "K", [f"{role}:{text}"]))
                for p, c, letter, more in ways:
                    way = (c, audit + letter, lines + more)
                    new[p] = min(new.get(p, way), way, key=lambda x: x[:2])
            best = new
        best = inserted(best)
        cost, audit, lines = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in cr.LEGAL for a, b in zip(own, own[1:]))
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def held(rows):
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_repair_equals_brute_force(spark, parts):
    g = random.Random(13)
    texts = ["Yes.", "No!", "open", "open end ", "", " \n", None, "What? ", "Fine. \t", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None]
    rows = [(c, g.choice([None, *range(9)]), g.choice(roles), g.choice(texts)) for c in [None, *range(60)] for _ in range(g.randint(1, 11))]
    rows += [(99, t, g.choice(roles), g.choice([f"text {t}.", f"text {t}", "Yes."])) for t in range(400)]
    rows += [(98, 5, "user", "same.")] * 40 + [(97, 3, "user", f"{i}.") for i in range(50)] + [(96, 1, "", "x.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("role", "role").selectExpr("*", "1 AS cost", "'x' AS piece")
        got = cr.repair_conversations(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = brute(rows)
    assert len(got) == len(want)
    wrong = [(k, v, want[k]) for k, v in held(got).items() if v != want[k]]
    assert not wrong, wrong[:3]


def test_nothing_and_everything_dropped(spark):
    assert cr.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = cr.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_prices_are_an_optimal_dual():
    """No arc is cheaper than the prices of its ends differ, and the origin's price is the cost of the path."""
    import numpy as np

    g = np.random.default_rng(1)
    rows = g.integers(1, 20, 50)
    shape = (50, 20)
    lattices = cr.Lattices(g.integers(0, 4, shape), g.random(shape) < 0.2, g.random(shape) < 0.3, g.integers(0, 2, shape), rows, np.full(50, 3))
    lattices.auction(0)
    lanes = np.arange(50)
    slack = lattices.cost + lattices.price[lanes[:, None, None], lattices.to] - lattices.price[:, :, None]
    assert (slack[lattices.cost < cr.FAR] >= 0).all()
    costs, edits = lattices.trace(0)
    assert (costs == lattices.price[:, 0]).all() and all(len(e.replace("I", "")) == n for e, n in zip(edits, rows))
