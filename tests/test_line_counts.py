import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.line_counts import counts_of_line, counts_of_lines
from granthi.plans.queries import REGISTRY

PARTS = ["अ", "का", "आदेश", "[", "A", "b", "xvi", "III", "the", "a5", "aB", "İx", "K", "rhythm", "é", "日本", "_", " ", ".", "ि"]


def by_definition(line: str) -> dict:
    def is_token(c):
        return c == "_" or "ऀ" <= c <= "ॿ" or unicodedata.category(c)[0] in "LN"

    tokens = "".join(c if is_token(c) else " " for c in line).split(" ")
    tokens = [t for t in tokens if t]
    low = [t.lower() for t in tokens]
    dev = [t for t in tokens if re.search("[ऀ-ॿ]", t)]
    long = [t for t in low if len(t) >= 3 and re.search("[a-z]", t) and not re.fullmatch("[ivxlcdm]+", t)]
    fragments = [t for t in dev if 2 <= len(t) <= 4]
    return {
        "chars": len(line), "n": sum(bool(re.search("[a-z]", t)) for t in low), "stop": int(any(t in lx.GATE_STOPWORDS for t in low)),
        "vowelled": sum(bool(re.search("[aeiouy]", t)) for t in low), "judged": len(long),
        "novowel": sum(not re.search("[aeiouy]", t) for t in long), "caps": sum(bool(re.search("[a-z][A-Z]", t)) for t in tokens),
        "dn": len(dev), "fused": sum(bool(re.search("[A-Za-z]", t)) for t in dev), "singles": sum(len(t) == 1 for t in dev),
        "intrusions": len(re.findall(r"[ऀ-ॿ][\[\]\\/{}<>@#$%^&*|~`A-Za-z][ऀ-ॿ]", line)),
        "runs": sum(a == b and len(a) > 1 for a, b in zip(dev, dev[1:])), "longest": max(Counter(fragments).values(), default=0),
    }


def test_counts_by_definition(spark):
    rnd = random.Random(3)
    lines = ["".join(rnd.choice(PARTS) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 20))) for _ in range(400)]
    lines += ["", "अ[अ[अ[अ", "का " * 200_000, "a" * 600_000]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    for row in df.select("i", counts_of_line(F.col("line")).alias("m")).collect():
        wanted = by_definition(lines[row.i])
        assert {f: row.m[f] for f in wanted} == wanted, lines[row.i][:80]


def test_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["the rule", None])], "i int, lines array<string>")
    got = {r.i: r.m for r in df.select("i", counts_of_lines(F.col("lines")).alias("m")).collect()}
    assert got[1] is None and got[2] == [] and got[3][0].n == 2 and got[3][1] is None


def test_a_line_is_counted_in_one_pass(spark, sf):
    for name in ("latin_score", "devanagari_score", "line_verdict", "page_clean"):
        plan = REGISTRY[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan, name
