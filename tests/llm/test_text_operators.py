"""Language ID, mixing, SentencePiece, HTML, tool calls: models, round trips and edge cases."""

import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare, connect
from granthi.llm import html_text, lang_id, mixing, piece_bpe, tool_calls
from granthi.llm.common import fold

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60000 + "é" * 30000
ODD = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, "the end of it", "en", "a", 3), (3, "the end of it", "en", "a", 3),
       (None, "un texte très court", None, "b", 4), (5, LONG, "en", None, 5), (6, "12 34 !!", "fr", "a", 6)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op2_mixing", "op3_tool_calls", "op7_substring_dedup", "op8_exact_topk"])
def test_query_equals_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf).toPandas(), connect(sf).execute(entry.oracle_sql()[name]).df()) == ""


def test_language_held_out_accuracy(spark, sf):
    found = entry.queries()["op1_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_language_edges(odd, empty):
    model = lang_id.fit(odd, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in lang_id.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= got and len(got) == 6
    nothing = lang_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in lang_id.predict(odd, nothing).collect()} == {"und"}
    assert lang_id.predict(empty, model).count() == 0


def test_language_score_does_not_depend_on_slices(odd, monkeypatch):
    model = lang_id.fit(odd, F.lit(True))
    texts = ["Ein Text", None, "autre texte", "x" * 999, ""]
    whole = model.scores(texts)
    monkeypatch.setattr(lang_id, "SLICE", 7)
    assert abs(model.scores(texts) - whole).max() < 1e-2


def test_mixing_meets_targets(spark):
    g = random.Random(4)
    docs = spark.createDataFrame(
        [(i, "w " * g.randint(0, 30), f"s{g.choice([0, 0, 0, 1, 2, 3])}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).join(docs, "doc_id").collect()
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken, target = by_source.get(r.source, (0, r.target))
        by_source[r.source] = (taken + r.taken, target)
    for taken, target in by_source.values():
        assert abs(taken - target) <= 1
    total = sum(r.size for r in rows)
    assert abs(sum(t for t, _ in by_source.values()) - 1.5 * total) <= len(by_source) + 1
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).join(docs, "doc_id").collect())


def test_mixing_targets_fill_like_vessels(spark):
    sizes = spark.createDataFrame([("a", 1, 100), ("b", 1, 10), ("c", 1, 300), (None, 1, 50)], "source string, rows long, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weight, left, open_, want = {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * 460, {"a", "b", "c", None}, {}
    size = {"a": 100, "b": 10, "c": 300, None: 50}
    while open_:  # the excess over twice a size is shared again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    assert got == pytest.approx(want)


def test_mixing_edges(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0
    assert mixing.repeat_documents(odd).columns == odd.columns


def test_repeats_match_taken(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    taken = {r.doc_id: -(-r.taken // r["size"]) for r in mixing.mix(docs).collect()}
    times = {r.doc_id: r["count"] for r in mixing.repeat_documents(docs).groupBy("doc_id").count().collect()}
    assert {k: v for k, v in taken.items() if v} == times


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.PieceCodec(piece_bpe.load_pieces(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_library(codec):
    own, library = codec
    g = random.Random(5)
    signs = "  \n\tabcdeéß日本ሴ\x00▁<>0x.,'ﬁ🙂 the ing"
    texts = ["".join(g.choice(signs) for _ in range(g.randint(0, 40))) for _ in range(3000)]
    texts += [" " * n + w + " " * m for n in range(0, 40, 3) for m in range(0, 40, 5) for w in ("", "word", "\n", "日")]
    texts += ["ab" * 5000 + "the" * 3000, "<s> </s> <unk> <0x0A>", LONG]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


def test_pieces_query(spark, sf, codec):
    _, library = codec
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.queries()["op5_sentencepiece"](spark, sf).collect():
        ids = library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_edges(odd, empty):
    rows = piece_bpe.encode_decode(odd, MODEL, with_text=True).collect()
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0] and len(rows) == len(ODD)
    assert next(r.decoded for r in rows if r.doc_id == 5) == LONG
    assert piece_bpe.encode_decode(empty, MODEL).count() == 0


def test_pages_give_their_article(spark, sf):
    """The synthetic pages hold their text in one article element: read here by patterns."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in entry.queries()["op4_html_text"](spark, sf).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pages_of_other_shapes(spark):
    body = ("<header class=masthead><a href=x>Site</a></header><div class='cookie-notice'>We use cookies</div>"
            "<nav><ul><li><a>Home</a></li></ul></nav>%s<aside>Side, text.</aside><section id='comments'><p>Nice, thanks.</p>"
            "</section><form><label>Mail</label><button>Go</button></form><footer>2020</footer>")
    main = "<h1>Title  here</h1><p>First, of\ttext.<p>Second &amp; <b>bold</b>ly.</p><div class='ad-box'>Buy</div><ul><li>item</li></ul>"
    pages = [(1, "u", body % f"<main>{main}</main>"), (2, "u", body % f"<div class=content>{main}</div>"), (3, "u", None),
             (4, "u", ""), (5, None, "plain words"), (6, "u", "<p>cut off <a href="), (7, "u", "<script>x</script"),
             (1, "u", body % f"<main>{main}</main>"), (None, "u", "<p>" * 3000 + "deep" + "<div>" * 3000)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = "Title here\nFirst, of text.\nSecond & boldly.\nitem"
    assert [r.text for r in got if r.page_id == 1] == [want, want] and [r.text for r in got if r.page_id == 2] == [want]
    assert {r.text for r in got if r.page_id in (3, 4, 7)} == {""} and len(got) == len(pages)
    assert [r.text for r in got if r.page_id == 5] == ["plain words"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_keeps_no_child_of_a_dropped_element():
    import numpy as np

    page = html_text.parse("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    forest = html_text.describe([page])
    kept = html_text.decode(forest, np.array([0.0, -5.0, 1.0, 1.0, -1.0, 4.0]))
    assert kept.tolist() == [True, False, False, False, True, True]


def test_page_sample_is_bounded_for_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SAMPLE_PAGES", 20)
    pages = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("page_id"), F.lit("u").alias("url"),
        F.concat(F.lit("<p>a paragraph of its own, number "), F.when(F.col("id") < 1500, F.col("id")).otherwise(0), F.lit("</p>")).alias("html"))
    runs = html_text.sampled_runs(pages, ("page_id", "url"), "html")
    assert 3 <= len(runs) <= 60
    monkeypatch.setattr(html_text, "SAMPLE_RUNS", 2)
    assert len(html_text.sampled_runs(pages, ("page_id", "url"), "html")) <= 2


def test_open_tags_and_rare_elements(spark):
    start = time.perf_counter()
    for opening in ("<b>", "<div>", "<li>", "<td>", "<p>", "</i>", "<b></i>"):
        page = html_text.parse("<article>" + opening * 100_000 + "end")
        forest = html_text.describe([page])
        kept = html_text.decode(forest, np.ones(len(page.tag)))
        assert html_text.blocks(page, kept) == "end" and forest.depth.max() < len(page.tag)
    assert time.perf_counter() - start < 60
    whole = lambda s: html_text.blocks(p := html_text.parse(s), np.ones(len(p.tag), bool))
    assert whole("<p>let <math><mi>x</mi></math> be <svg><text>n</text></svg> <noscript><b>bold</b></noscript></p>") == "let x be n bold"
    assert whole('<p title="it>Body text</p><p>more</p>') == "Body text\nmore"
    assert whole("""<p title='a>b' id = "c>d" lang=it's>one</p><p data-x="y>z">two</p>""") == "one\ntwo"
    assert whole("<p>a<p>b<table><tr><td><p>c<td>d<tr><td>e</table>f<ul><li>g<ul><li>h</ul><li>i</ul>") == "a\nb\nc\nd\ne\nf\ng\nh\ni"
    body = "".join(f"<p>Paragraph {i} says that the long road, the bridge and the mill belong to the village.</p>" for i in range(8))
    source = f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1>{body}<p>so let <math><mi>x</mi></math> be given, and go on.</p></article></body></html>"
    words = spark.createDataFrame([(i, "u", source) for i in range(3)], "page_id long, url string, html string")
    assert all("so let x be given" in r.text and "Home" not in r.text for r in html_text.extract(words).collect())


def test_features_against_a_walk_up():
    g = random.Random(4)
    names = ["div", "p", "a", "li", "ul", "b", "td", "table", "nav"]
    pages = []
    for _ in range(5):
        parts = [g.choice([f"<{n} class='ad'>", f"<{n}>", f"</{n}>", "some, text."]) for n in g.choices(names, k=80)]
        pages.append(html_text.parse("".join(parts)))
    forest = html_text.describe(pages)
    n = len(forest.parent)
    for i in range(n):
        line = [i]
        while forest.parent[line[-1]] != line[-1]:
            line.append(int(forest.parent[line[-1]]))
        assert forest.depth[i] == len(line) - 1 and all(a > b for a, b in zip(line, line[1:]))
    chars = np.expm1(forest.features[:, 0].astype(float)).round()
    total = chars.copy()
    for i in range(n - 1, -1, -1):
        if forest.parent[i] != i:
            total[forest.parent[i]] += total[i]
    assert np.allclose(np.expm1(forest.features[:, 1].astype(float)), total, atol=0.01)


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "search", '{"query": "x", "limit": 3}', None), (1, "b", 1, "search", '{"limit": "3", "z": {"k": 1, "a": [2]}}', ["a"]),
        (1, "c", 2, "other", "{}", ["b", "a", "gone"]), (1, "d", 3, "search", "not json", ["e"]), (1, "e", 4, "search", None, ["d"]),
        (1, "a", 0, "search", '{"query": "x", "limit": 3}', None), (None, "q", 0, "search", "{}", None), (2, "a", 9, None, '{"query": null}', []),
    ], "conv_id long, call_id string, place long, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([(1, "a", 5, "r1"), (1, "a", 6, "r2"), (1, "b", 7, None), (1, "zz", 8, "lost"), (None, "a", 1, "n")],
                                    "conv_id long, call_id string, place long, content string")
    schemas = spark.createDataFrame([("search", "query", "string", True), ("search", "limit", "number", False)],
                                    "name string, field string, kind string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert len(got) == 6
    a, b = got[1, "a"], got[1, "b"]
    assert (a.level, a.has_result, a.errors) == (0, True, "spare results")
    assert a.json == '{"arguments":{"limit":3,"query":"x"},"id":"a","level":0,"name":"search","result":"r1"}'
    assert (b.level, b.has_result, b.errors) == (1, True, "missing: query; not in schema: z; wrong type: limit")
    assert '"arguments":{"limit":"3","z":{"a":[2],"k":1}}' in b.json
    assert (got[1, "c"].level, got[1, "c"].errors) == (2, "unknown tool")
    assert got[1, "d"].level is None and got[1, "d"].errors == "arguments are no object; cycle; missing: query" and got[1, "e"].level is None
    assert got[2, "a"].errors == "unknown tool"
    assert {r.content for r in tool_calls.orphans(calls, results).collect()} == {"lost", "n"}
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_rows_without_a_link(spark):
    calls = spark.createDataFrame([
        (1, "a", 3, "t", "{}", None, "x"), (1, "a", 3, "t", "{}", None, "y"), (1, "a", 4, "t", '{"k": 1}', ["b"], "x"), (1, "a", None, None, None, None, "x"),
        (1, None, 5, "t", "{}", None, "x"), (None, None, None, None, None, None, None)],
        "conv_id long, call_id string, place long, name string, arguments string, depends array<string>, status string")
    results = spark.createDataFrame([(1, "a", 6, "r"), (1, "a", 6, "r"), (1, "a", 7, None), (1, "z", 8, "lost"), (1, "z", 8, "lost"), (None, None, None, None)],
                                    "conv_id long, call_id string, place long, content string")
    schemas = spark.createDataFrame([("t", "k", "integer", False)], "name string, field string, kind string, required boolean")
    assert [(r.place, r.errors) for r in tool_calls.link(calls, results, schemas).collect()] == [
        (None, "arguments are no object; spare results; unknown tool")]
    left = sorted((r.status, str(r.conv_id), str(r.place)) for r in tool_calls.unlinked(calls, results).collect())
    assert left == [("call without id", "1", "5"), ("call without id", "None", "None"), ("orphan result", "1", "8"), ("orphan result", "1", "8"),
                    ("orphan result", "None", "None"), ("repeated id", "1", "3"), ("repeated id", "1", "4"),
                    ("spare result", "1", "6"), ("spare result", "1", "7")]
    assert tool_calls.unlinked(calls.limit(0), results.limit(0)).count() == 0


def test_levels_against_longest_paths(spark):
    g = random.Random(5)
    needs = {}
    for c in range(6):
        for i in range(40):
            needs[c, i] = [j for j in {g.randrange(-2, 40) if c == 5 else g.randrange(-2, max(i, 1)) for _ in range(g.randint(0, 3))} if j != i or c == 5]
    for i in range(600):  # one long chain
        needs[9, i] = [i - 1] if i else []
    for i in range(10):  # a cycle, what needs it, and what it needs
        needs[10, i] = [(i + 1) % 4] if i < 4 else [i - 1] if i < 8 else []
    needs[10, 0].append(9)
    expected, settled = {}, True
    while settled:
        settled = {k: max([expected[k[0], j] + 1 for j in v if (k[0], j) in needs], default=0)
                   for k, v in needs.items() if k not in expected and all((k[0], j) in expected for j in v if (k[0], j) in needs)}
        expected |= settled
    calls = spark.createDataFrame([(c, str(i), [str(j) for j in v]) for (c, i), v in needs.items()],
                                  "conv_id long, call_id string, depends array<string>")
    got = {(r.conv_id, int(r.call_id)): r.level for r in tool_calls.levels(calls).collect()}
    assert got == expected and expected[9, 599] == 599 and (10, 7) not in got


def test_whole_turns_are_rows(spark, tmp_path):
    g = random.Random(3)
    text = lambda: " ".join(g.choices(["find", "the", '"old"', "bill"], k=g.randint(30, 300)))
    roles = ["system", "user", "assistant", "user", "user", "assistant", "assistant", None, None, "assistant"]
    turns = [(c, i, role, text()) for c in (1, 2, 3) for i, role in enumerate(roles)] + [(None, 4, "assistant", "x y"), (9, 0, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = entry.queries()["op3_tool_calls"](spark, str(tmp_path)).collect()
    called = {(c, i) for c, i, role, _ in turns if role == "assistant" and c is not None}
    at = {(r.conv_id, r.place, r.status): json.loads(r.json) for r in rows}
    assert len(at) == len(rows)
    assert {k[:2] for k in at if k[2] == "call"} == called and (None, 4, "call without id") in at
    alone = {(c, i): t for c, i, role, t in turns if role != "assistant" and (c, i - 1) not in called}
    assert {k[:2]: v["result"] for k, v in at.items() if k[2] == "orphan result"} == alone
    linked = {(c, i - 1): t for c, i, role, t in turns if role != "assistant" and (c, i - 1) in called}
    asked = 0
    for c, i, role, t in turns:
        if (c, i) in called:
            got = at[c, i, "call"]
            assert got["arguments"].get("query") == (t if len(t.split()) % 3 else None) and got["result"] == linked.get((c, i))
            asked += "query" in got["arguments"]
    assert asked


def test_fold_is_crc32(spark):
    rows = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in rows)
