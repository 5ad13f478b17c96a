import random
import re

from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.text import WS_CHARS, gazette_numbers, normalise, standard_numbers
from granthi.operators import chunking

T, OV, MIN = lx.CHUNK_TARGET_CHARS, lx.CHUNK_OVERLAP_CHARS, lx.CHUNK_MIN_CHARS


def model_pack(units):
    """Greedy packing stated as a plain loop."""
    out, buf = [], ""
    for u in units:
        if buf and len(buf) + 1 + len(u) > T:
            out.append(buf.strip())
            head, sep, rest = buf[-OV:].partition(" ")
            buf = (rest if sep else "") + " " + u
        else:
            buf = (buf + " " + u).strip()
    rest = buf.strip()
    if len(rest) >= MIN:
        out.append(rest)
    elif rest and out:
        out[-1] += " " + rest
    return out


def pages_of(seed):
    rng = random.Random(seed)
    words = ["rule", "Board", "licence;", "mark.", "of", "the", "Standard:", "x" * 40]
    rows = []
    for doc in range(30):
        for page in range(1, rng.randint(2, 4)):
            parts = []
            for _ in range(rng.randint(1, 25)):
                lead = rng.choice(["(a) ", "(iv) ", "4.2 ", "Provided that ", ""])
                n = rng.choice([3, 10, 60, 260])
                parts.append(lead + " ".join(rng.choice(words) for _ in range(n)))
            rows.append((doc, page, "\n".join(parts), "ok" if rng.random() < 0.9 else "empty"))
    rows.append((99, 1, "z" * 2500 + ". " + "A" * 1300, "ok"))
    return rows


def test_units_and_packing_match_the_loop(spark):
    rows = pages_of(7)
    df = spark.createDataFrame(rows, "doc_id int, page_number int, text string, status string")
    got = df.select("doc_id", "page_number", "text", chunking.clause_units(F.col("text")).alias("u")).collect()
    for r in got:
        assert all(0 < len(u) <= T for u in r.u)
        assert re.sub(r"\s+", "", "".join(r.u)) == re.sub(r"\s+", "", r.text)
    units = {(r.doc_id, r.page_number): r.u for r in got}
    chunks = {}
    for r in chunking.chunk_pages(df, ["doc_id"]).orderBy("doc_id", "page_number", "pos").collect():
        chunks.setdefault((r.doc_id, r.page_number), []).append(r.text)
    for doc, page, text, status in rows:
        expected = model_pack(units[(doc, page)]) if status == "ok" and len(text.strip()) >= MIN else []
        assert chunks.get((doc, page), []) == expected


def test_short_tail_joins_without_new_identifiers(spark):
    body = ("word " * 218).strip() + "\n(b) " + ("term " * 150).strip() + "\n(c) " + ("next " * 70).strip() + "\n(d) see IS 1234"
    df = spark.createDataFrame([(1, 1, body, "ok")], "doc_id int, page_number int, text string, status string")
    rows = chunking.chunk_pages(df, ["doc_id"]).orderBy("pos").collect()
    assert "IS 1234" in rows[-1].text


def test_ordinals_run_over_pages(spark):
    rows = [(1, p, pos, f"t{p}-{pos}", [], []) for p in (1, 2, 1500, 4000) for pos in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, pos int, text string, standard_ids array<string>, gazette_ids array<string>")
    got = chunking.number_chunks(df, "doc_id").orderBy("page_number", "ordinal").collect()
    assert [r.ordinal for r in got] == list(range(12)) and len({r.chunk_id for r in got}) == 12


def test_packing_never_lists_all_characters_of_its_buffer(spark):
    """Cutting both ends of the buffer at every unit made most of the cost of a page."""
    units = spark.createDataFrame([(["a b", "c"],)], "u array<string>")
    plan = units.select(chunking.pack_units(F.col("u")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ltrim(" in plan and not re.search(r"(?<![lr])trim\(|rtrim\(", plan)


def test_guarded_steps_equal_the_plain_ones(spark):
    ends = ["", " ", "\t", "\n", "\u3000", "\x1c", "\u200b", "\ufeff", "\u00a0\u00a0", "\n\n\n\n"]
    texts = [a + m + b for a in ends for b in ends for m in ("", "x", "x  y", "x\ty", "x\n\n\n\ny", "\u0905\u00a0 \u202fz", "IS 123", "S.O. 12( \u2003e )", "GSR 7 (E) IS:456")]
    odd = str.maketrans("\u00a0\u2007\u202f", "   ", "\u200b\u200c\u200d\ufeff")
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(
        "t", normalise(F.col("t")).alias("n"), standard_numbers(F.col("t")).alias("s"), gazette_numbers(F.col("t")).alias("g"))
    for r in df.collect():
        if r.t is None:
            assert (r.n, r.s, r.g) == (None, None, None)
            continue
        want = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", r.t.translate(odd))).strip(WS_CHARS)
        assert r.n == want, repr(r.t)
        assert len(r.s) == ("IS" in r.t) and len(r.g) == ("e )" in r.t or "(E)" in r.t), repr(r.t)
