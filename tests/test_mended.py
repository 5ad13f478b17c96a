"""Nothing is dropped: page text, question terms, hits without a passage, texts without a run, long rule tables."""

import random
import re

from pyspark.sql import functions as F

from granthi.operators import answers, dedup, index, marks, overlap, retrieval, webpages
from granthi.sources import corpus

WORDS = re.compile(r"\w+")


def test_page_words_in_are_words_out(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {}
    for r in webpages.html_blocks(pages).collect():
        out.setdefault(r.page_id, []).append(r.text)
    import html
    for r in pages.collect():
        plain = re.sub(r"<(script|style)\b.*?(</\1>|\Z)", " ", r.html, flags=re.S)
        plain = re.sub(r"<!--.*?(-->|\Z)", " ", plain, flags=re.S)
        plain = html.unescape(re.sub(r"</?(b|i|a|span)\b[^>]*>", "", plain).replace("<", " <").replace(">", "> ") and
                              re.sub(r"<[^>]*(>|\Z)", " ", re.sub(r"</?(b|i|a|span)\b[^>]*>", "", plain)))
        assert WORDS.findall(" ".join(out[r.page_id])) == WORDS.findall(plain)


def test_loose_text_tables_and_inline_tags(spark):
    page = ("loose <b>bo</b>ld<div>in a div</div><blockquote>quoted</blockquote><table><caption>cap</caption><tr><td>a<td>b</tr>"
            "<tr><td><p>c</p>d</td></tr>stray</table><p>one<br>two</p>tail")
    got = [(r.kind, r.text) for r in webpages.html_blocks(
        spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("pos").collect()]
    assert got == [("other", "loose bold"), ("other", "in a div"), ("other", "quoted"), ("other", "cap"),
                   ("table", "| a | b |\n| --- | --- |\n| c d |"), ("other", "stray"), ("paragraph", "one two"), ("other", "tail")]


def test_all_terms_of_a_long_question_count(spark):
    text = " ".join(f"term{i}" for i in range(90))
    df = spark.createDataFrame([(1, text)], "query_id long, text string")
    assert retrieval.query_terms(df).count() == 90
    assert df.select(F.size(retrieval.query_phrases(F.col("text"), 40))).first()[0] == 40


def test_hits_without_a_passage_leave_no_gap(spark):
    passages = spark.createDataFrame(
        [(c, f"Zinc rule {c}. Other text.", f"f{c}.txt", 1, "t", "c", None) for c in (10, 30, 70)],
        "chunk_id long, text string, relpath string, page_number int, title string, category string, source_url string")
    hits = spark.createDataFrame(
        [(1, c, r, 1.0 / r, r, 1.0, None, None) for r, c in enumerate([10, 11, 30, 31, 32, 33, 70], 1)],
        "query_id long, chunk_id long, rank int, score double, keyword_rank int, keyword_score double, semantic_rank int, semantic_score double")
    asked = spark.createDataFrame([(1, "zinc rule", "English")], "query_id long, text string, language string")
    hydrated = retrieval.hydrate(hits, passages)
    assert sorted((r.rank, r.chunk_id) for r in hydrated.collect()) == [(1, 10), (2, 30), (3, 70)]
    answer = answers.extractive_answers(asked, hydrated).first()
    assert answer.cited == [1, 2, 3] and all(f"[S{i}]" in answer.answer for i in (1, 2, 3))
    sources = answers.source_blocks(hydrated).first().sources
    assert re.findall(r"\[S(\d)\] t\n\(file: f(\d+)", sources) == [("1", "10"), ("2", "30"), ("3", "70")]
    shown = answers.cited_sources(spark.createDataFrame([(1, [3])], "query_id long, cited array<int>"), hydrated).collect()
    assert [(r.rank, r.chunk_id) for r in shown] == [(3, 70)]


def test_redaction_keeps_other_texts_and_white_space(spark):
    texts = spark.createDataFrame([(1, "a\n b  c\td e "), (2, "  nothing\nhere "), (3, None)], "id long, text string")
    runs = spark.createDataFrame([(1, 1, 2, "x"), (1, 2, 2, "y"), (1, 1, 1, "x")], "id long, left_start int, n_words int, clause string")
    got = {r.id: (r.redacted, r.spans) for r in overlap.redact_runs(texts, runs, "id", "clause").collect()}
    assert got == {1: ("a\n [see x, y] e ", 1), 2: ("  nothing\nhere ", 0), 3: (None, 0)}


def test_many_keywords(spark):
    products = spark.createDataFrame([(i, f"Item No{i} of steel") for i in range(300)], "product_id long, description string")
    rules = spark.range(12000).select(F.concat(F.lit("s"), "id").alias("scheme"), F.concat(F.lit("no"), "id", F.lit(" ")).alias("keyword"))
    got = {(r.product_id, r.scheme) for r in marks.match_schemes(products, rules).collect()}
    assert got == {(i, f"s{i}") for i in range(300)}


def test_keywords_of_unlike_lengths(spark):
    g = random.Random(2)
    texts = ["".join(g.choices("abAB c", k=g.randint(0, 60))) for _ in range(200)] + [None, ""]
    words = ["a", "Z", "", "ab c", *{"".join(g.choices("abc ", k=k)) for k in (2, 3, 5, 8, 9, 17, 20) for _ in range(4)}, texts[0], texts[1][3:30]]
    products = spark.createDataFrame(list(enumerate(texts)), "product_id long, description string")
    rules = spark.createDataFrame([(f"s{i % 9}", w) for i, w in enumerate(words)], "scheme string, keyword string")
    got = [(r.product_id, r.scheme) for r in marks.match_schemes(products, rules).collect()]
    want = {(p, f"s{i % 9}") for p, t in enumerate(texts) for i, w in enumerate(words) if t and w and w.lower() in t.lower()}
    assert len(got) == len(set(got)) and set(got) == want
    assert marks.match_schemes(products, rules.limit(0)).count() == 0


def test_last_write_of_equal_times(spark):
    rows = [("k", v, 1) for v in ("b", "c", "a")] + [("k", "z", 0), ("n", None, 2)]
    entries = spark.createDataFrame(rows, "key string, value string, ts long")
    assert {r.key: r.value for r in corpus.latest_meta(entries).collect()} == {"k": "c", "n": None}


def test_ingest_of_a_hot_hash(spark):
    rows = [(i, "hot", None if i % 7 else "broken") for i in range(500)] + [(500, "old", None), (501, None, "x"), (502, "hot", None)]
    batch = spark.createDataFrame(rows, "row_id long, h string, error string")
    planned = dedup.plan_ingest(batch, spark.createDataFrame([("old",)], "h string"), ["h"])
    got = {r.row_id: r.status for r in planned.collect()}
    assert len(got) == 503 and [i for i, s in got.items() if s == "created"] == [1] and got[500] == "unchanged" and got[501] == "failed"
    assert all((got[i] == "failed") == (i % 7 == 0) for i in range(500)) and got[502] == "skipped"


def test_hashed_vectors_use_all_slots(spark):
    text = " ".join(f"w{i}" for i in range(20000))
    vector = spark.createDataFrame([(text,)], "text string").select(index.hashed_vector(F.col("text"), 1024)).first()[0]
    assert len(vector) == 1024 and sum(x > 0 for x in vector) > 1000


def test_search_over_the_written_index(spark, tmp_path):
    from granthi.sources import corpus

    passages = spark.createDataFrame(
        [(1, "red zinc IS 302 part", "t", "c"), (2, "zinc red red", "t zinc", "c"), (3, "blue", None, None), (4, "302 is red zinc", "x", "c")],
        "chunk_id long, text string, title string, category string")
    weights = {"text": 1.0, "title": 0.5}
    asked = spark.createDataFrame([(1, "IS 302 zinc"), (2, "red red"), (3, ""), (4, "IS 302 zinc")], "query_id long, text string")
    tables = retrieval.keyword_index(passages, weights)
    corpus.write_index(tables, str(tmp_path))
    stored = corpus.read_index(spark, str(tmp_path), list(tables))
    found = retrieval.indexed_search(stored, asked, 3, weights)
    plain = retrieval.keyword_search(passages, asked, 3, weights)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(found) == key(plain) and key(found)


def test_log_lines_keep_their_order_over_files(spark, tmp_path):
    from granthi.sources import corpus

    head = ",".join(f.name for f in corpus.PROVENANCE_SCHEMA)
    name, url = [f.name for f in corpus.PROVENANCE_SCHEMA].index("filename"), [f.name for f in corpus.PROVENANCE_SCHEMA].index("source_url")

    def line(file, where):
        cells = [""] * len(corpus.PROVENANCE_SCHEMA)
        cells[name], cells[url] = file, where
        return ",".join(cells)

    (tmp_path / "a.csv").write_text("\n".join([head, line("x", "first")]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([head, line("x", "second"), *(line(f"y{i}", "u") for i in range(2000))]) + "\n")
    (tmp_path / "c.csv").write_text("\n".join([head, line("x", "third"), line("x", "last"), line("z", "u")]) + "\n")
    got = {r.filename: r.source_url for r in corpus.source_urls(corpus.read_provenance_csv(spark, str(tmp_path))).collect()}
    assert got["x"] == "last"


def test_metadata_and_matrix_are_written(spark, tmp_path):
    from granthi.sources import corpus

    schema = "key string, value string, ts timestamp"
    corpus.write_meta(spark.sql("SELECT 'k' AS key, 'old' AS value, timestamp '2024-01-01' AS ts"), f"{tmp_path}/meta")
    corpus.write_meta(spark.sql("SELECT 'k' AS key, 'new' AS value, timestamp '2024-01-02' AS ts"), f"{tmp_path}/meta")
    asked = spark.createDataFrame([("k",), ("none",)], "key string")
    got = corpus.meta_value(spark.read.schema(schema).parquet(f"{tmp_path}/meta"), asked, "-")
    assert {(r.key, r.value) for r in got.collect()} == {("k", "new"), ("none", "-")}
    for rows in ([("1", "a")], [("2", "b")]):
        corpus.write_matrix(spark.createDataFrame(rows, "hsn_cd string, product string"), f"{tmp_path}/matrix")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/matrix").collect()] == [("2", "b")]
