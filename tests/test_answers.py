import pytest
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions import questions as qf
from granthi.operators import answers, context, marks, overlap, reports, routing, tariff


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_intents(spark):
    asked = ["hi", "Hello there!", "thanks", "thanks !", "who are you?", "तुम कौन है?", "hello which licence do I need", "", None]
    assert column(spark, asked, qf.intent) == [
        "greeting", "greeting", "courtesy", "question", "about", "about", "question", "question", "question"]


@pytest.mark.parametrize("text,inside", [
    ("Who won the cricket match?", False), ("Is IS 302 mandatory?", True), ("please visit me", True), ("ab", False),
    ("which films were made", False), ("do imports need testing", True), ("यह क्या है", True), ("blue sky", False),
    ("Is a driving licence accepted by bis?", True), ("income tax rate", False),
])
def test_scope(spark, text, inside):
    assert column(spark, [text], lambda c: qf.scope(c)["in_scope"]) == [inside]


def test_follow_ups_and_history_across_blocks(spark):
    n = 3000
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"question number {t} about the long topic here" if t % 2 == 0 else ("" if t % 5 == 0 else f"reply {t}"))
             for t in range(n)]
    turns.append((1, n, "user", "what about imports?"))
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    exp = {r.turn: r.expanded for r in context.expand_follow_ups(df).collect()}
    assert exp[n] == f"question number {n - 2} about the long topic here what about imports?"
    assert exp[2048] == turns[2048][3]
    hist = {r.turn: r.history for r in context.history_blocks(df).collect()}
    for t in (0, 1, 7, 1024, 1137, 1138, 1139, 2276, 2280, n):
        said = [x for x in turns[:t] if x[3]][-6:]
        lines = "\n".join(("User: " if r == "user" else "Assistant: ") + text for _, _, r, text in said)
        assert hist[t] == (f"{lx.HISTORY_HEADER}\n{lines}\n\n" if said else "")


def test_citations(spark):
    rows = [(1, "A [S2] b [S9]  c [S1][S2].", 3), (2, "Only [S099] here", 3), (3, "none", 3)]
    got = {r.query_id: r for r in answers.check_grounding(spark.createDataFrame(rows, "query_id int, answer string, n_sources int")).collect()}
    assert got[1].cited == [1, 2] and got[1].invalid == [9] and got[1].answer == "A [S2] b c [S1][S2]." and got[1].grounded
    assert got[2].invalid == [99] and got[2].general_knowledge and got[2].answer == "Only here"
    assert not got[3].grounded


def test_zero_padded_marker_stays(spark):
    df = spark.createDataFrame([("Only [S099] here [S12]",)], "a string")
    assert df.select(answers.check_citations(F.col("a"), F.lit(3))["text"]).first()[0] == "Only [S099] here"


def test_best_sentences_keep_text_order(spark):
    df = spark.createDataFrame([("Alpha fee. Beta licence fee; Gamma fee: delta.", ["fee", "licence"])], "t string, q array<string>")
    assert df.select(answers.best_sentences(F.col("t"), F.col("q"))).first()[0] == ["Beta licence fee;", "Alpha fee."]


def test_leaks(spark):
    texts = ["We need to check this", "Let's look at it", "The fee is 5. We need to pay.", "Okay, so the answer"]
    assert column(spark, texts, qf.leaked_reasoning) == [True, True, False, True]


def test_marks(spark):
    values = ["CM/L-6300082303", "cml 123456", "R-12345678", "IS 302 (Part 1): 2008", "AB12CD", "ABCDEF", "IS1234", "CM/L 12345", "", None, "CM/L 12345678901"]
    assert column(spark, values, marks.mark_kind) == [
        "licence", "licence", "crs", "standard", "hallmark", "unknown", "standard", "unknown", "unknown", "unknown", "licence"]
    row = marks.decode(spark.createDataFrame([("CM/L 12345678901",)], "value string")).first()
    assert row.recognised and row.warnings == ["expected 10 digits, found 11"]


@pytest.mark.parametrize("answers_,code", [
    ({"sector": "consumer", "need": "verify"}, "CONSUMER-VERIFY"),
    ({"sector": "industrial", "industry": "gold", "location": "india", "trade": "export"}, "EXPORT"),
    ({"sector": "industrial", "industry": "electronics", "location": "abroad", "trade": "domestic"}, "CRS"),
    ({"sector": "Industrial", "industry": "gold", "location": "india", "trade": "import"}, "HALLMARK"),
    ({"sector": "industrial", "industry": "steel", "location": "india", "trade": "import"}, "FMCS"),
    ({"sector": "industrial", "industry": "steel", "location": "abroad", "trade": "domestic"}, "FMCS"),
    ({"sector": "industrial", "industry": "steel", "location": "india", "trade": "domestic"}, "ISI"),
    ({"sector": "industrial", "industry": "toys", "location": "india", "trade": "domestic"}, None),
    ({"sector": "industrial", "industry": "steel", "trade": "domestic"}, None),
    ({}, None),
])
def test_routes(spark, answers_, code):
    rows = routing.route(spark.createDataFrame([(1, answers_)], "case_id int, answers map<string,string>")).collect()
    assert [r.scheme_code for r in rows] == ([code] if code else [])


def test_tariff_code(spark):
    assert column(spark, ["HSN 0101.10", "none", "000", None], tariff.code_key) == ["10110", None, "0", None]
    assert column(spark, ["I sell kettles, what HSN code?"], tariff.product_query)[0].split() == ["I", "kettles,", "what", "?"]


def test_runs_are_found_and_redacted(spark):
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(["intro"] + words[10:60] + ["mid"] + words[80:105] + ["end"]))], "doc_id int, text string")
    items = spark.createDataFrame([(7, " ".join(words).upper())], "item_id int, text string")
    runs = overlap.verbatim_runs(docs, items, "doc_id", "item_id")
    assert [tuple(r) for r in runs.collect()] == [(1, 7, 1, 10, 50)]
    named = runs.withColumn("clause", F.lit("clause 4"))
    out = overlap.redact_runs(docs, named, "doc_id", "clause").first().redacted
    assert out == " ".join(["intro", "[see clause 4]", "mid"] + words[80:105] + ["end"])


def test_category_sums_do_not_fan_out(spark):
    docs = spark.createDataFrame([(1, "a", 10, 1, 3), (2, "a", 10, 1, 3)], "doc_id int, category string, page_count int, pages_scanned int, pages_corrupt int")
    chunks = spark.createDataFrame([(1,)] * 12 + [(2,)] * 2, "doc_id int")
    assert tuple(reports.category_stats(docs, chunks).first()) == ("a", 2, 20, 2, 6, 14)


def test_eval_counts_missing_modes_as_misses(spark):
    cases = spark.createDataFrame([(1, m, "GUIDE") for m in ("keyword", "semantic")], "query_id int, mode string, expect_doc string")
    hits = spark.createDataFrame([(1, "keyword", 1, "x/a.txt"), (1, "keyword", 2, "x/guide.txt")], "query_id int, mode string, rank int, relpath string")
    got = {r["mode"]: r for r in reports.retrieval_scores(reports.expected_ranks(cases, hits)).collect()}
    assert (got["keyword"].mrr, got["keyword"].hit_at_1, got["semantic"].mrr) == (0.5, 0.0, 0.0)
