import pytest
from pyspark.sql import functions as F

from granthi.functions import text as tx
from granthi.operators import pages

LINES = [
    ("The maker shall apply to the board for a licence under this rule.", "latin", "keep", "ok"),
    ("vlk/kkj.k Hkkx [k.M jftLVªh laö Mhö dkj", "latin", "reject", "latin gibberish"),
    ("केन्द्रीय सरकार का यह आदेश लागू होगा", "devanagari", "keep", "ok"),
    ("मान[क असेZयग चिह्]न", "devanagari", "reject", "devanagari corruption"),
    ("12 / 34 - 56", "neutral", "reject", "no letters"),
    (" a ", "neutral", "reject", "too short"),
    ("/uni0915 some words of text", "latin", "reject", "unmapped glyph escapes"),
    ("आदेश EXTRA", "mixed", "keep", "ok"),
    ("क ख ग घ च छ ज झ ट ठ", "devanagari", "reject", "devanagari corruption"),
    ("अनाज अनाज अनाज अनाज अनाज", "devanagari", "keep", "ok"),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(LINES)], "line_id int, line string")
    return {r.line_id: r for r in pages.judge_lines(df).collect()}


@pytest.mark.parametrize("i", range(len(LINES) - 1))
def test_verdicts(judged, i):
    _, script, verdict, reason = LINES[i]
    assert (judged[i].script, judged[i].verdict, judged[i].reason) == (script, verdict, reason)


def test_repeated_tokens_cost_half(judged):
    assert judged[9].score == pytest.approx(0.5)


def test_page_keeps_order_and_counts(spark):
    good = "The board shall keep a register of all licences that are in force."
    raw = f"{good}\n12 34\r\nab\n{good} Again.\n"
    row = pages.with_page_status(pages.clean_pages(
        spark.createDataFrame([(1, 1, raw)], "doc_id int, page_number int, raw string"), ["doc_id", "page_number"]
    )).first()
    assert row.text == f"{good}\n{good} Again." and row.status == "ok"
    assert (row.kept_lines, row.dropped_lines) == (2, 2)
    assert row.dropped_reasons == {"no letters": 1, "too short": 1} and row.scripts == {"latin": 2}


@pytest.mark.parametrize("raw,status", [("  \n ", "scanned"), ("short text", "empty"), ("Hkkx dkj [k.M vlk\n" * 20, "mostly_corrupt")])
def test_page_status(spark, raw, status):
    df = spark.createDataFrame([(1, raw)], "doc_id int, raw string")
    assert pages.with_page_status(pages.clean_pages(df, ["doc_id"])).first().status == status


def test_line_breaks(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc d\n\ne\n",), ("",)], "raw string")
    got = [r[0] for r in df.select(tx.split_lines(F.col("raw"))).collect()]
    assert got == ["a\r\nb\x0bc d\n\ne\n".splitlines(), []]


def test_mojibake(spark):
    rows = [("rods â€” all", "rods — all"), ("château", "château"), ("plain", "plain"), ("é â€” x", "é â€” x"), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(tx.fix_mojibake(F.col("t"))).collect()] == [b for _, b in rows]


def test_tokens_and_identifiers(spark):
    t = "Café co-op foo_bar; IS 17440 : 2020, IS/IEC 62368-1, IS 302 (Part 1); s.o. 39 (e) and the fee is 500"
    row = spark.createDataFrame([(t,)], "t string").select(
        tx.search_tokens(F.col("t")).alias("tok"), tx.standard_numbers(F.col("t")).alias("s"), tx.gazette_numbers(F.col("t")).alias("g")).first()
    assert row.tok[:5] == ["cafe", "co", "op", "foo", "bar"]
    assert row.s == ["IS 17440 : 2020", "IS/IEC 62368-1", "IS 302 (PART 1)"] and row.g == ["S.O. 39 (E)"]
