"""Registered queries: every operator applied to whole tables or to inputs derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granthi import lexicons as lx
from granthi.functions import gate
from granthi.functions import questions as qf
from granthi.functions import text as tx
from granthi.functions.line_counts import counts_of_line
from granthi.operators import (
    answers, bounded, chunking, context, dedup, index, marks, overlap, pages, pivots, reports, retrieval, routing,
    tariff, webpages,
)
from granthi.plans import derived as d
from granthi.session import broadcast_if_small, materialise, settled, shared_dir
from granthi.sources import corpus as src
from granthi.sources import segments
from granthi.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Flat columns for comparison: long integers, doubles at 6 places, lists as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), " | ")
        elif isinstance(f.dataType, T.MapType):
            c = F.array_join(F.sort_array(F.transform(
                F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), "; ")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- sources and sinks -------------------------------------------------------------


@query
def corpus_paths(spark, sf):
    """Documents, benchmark items in an excluded folder, labels one level deep."""
    paths = d.table(spark, sf, "documents").select(d.s(F.col("source"), "/", F.col("lang"), "/doc_", F.col("doc_id"), ".txt").alias("relpath"))
    paths = paths.unionByName(d.table(spark, sf, "benchmark").select(d.s("_meta/item_", F.col("item_id"), ".txt").alias("relpath")))
    paths = paths.unionByName(d.table(spark, sf, "labels").select(d.s("labels/Quality-List__dup2__", F.col("doc_id"), ".csv").alias("relpath")))
    return src.with_path_parts(paths)


@query
def page_explode(spark, sf):
    return plain(src.explode_pages(d.paged_documents(spark, sf), ["doc_id"]))


def _provenance(spark, sf):
    k = F.col("page_id")
    return d.table(spark, sf, "pages").select(
        F.when(k % 9 == 0, "  ").otherwise(d.s(" doc_", k % 100, ".txt ")).alias("filename"),
        F.when(k % 7 == 0, "").otherwise(F.col("url")).alias("source_url"), k.alias("line_id"))


@query
def source_urls(spark, sf):
    return src.source_urls(_provenance(spark, sf))


@query
def source_url_join(spark, sf):
    docs = d.corpus(spark, sf).select("doc_id", "filename")
    return dedup.attach_source_urls(docs, src.source_urls(_provenance(spark, sf))).select("doc_id", "filename", "source_url")


@query
def tariff_load(spark, sf):
    return src.load_tariff(d.raw_tariff(spark, sf))


@query
def golden_cases(spark, sf):
    k = F.col("item_id")
    line = F.to_json(F.struct(
        F.col("text").alias("question"), d.s("src", k % 20, "/").alias("expect_doc"),
        F.when(k % 3 == 0, "checked").alias("note"), F.when(k % 4 == 0, "hi").alias("language")))
    lines = d.table(spark, sf, "benchmark").select(F.explode(F.array(
        line, F.lit("// a comment"), F.lit("   "))).alias("value"))
    return src.golden_cases(lines)


@query
def run_meta_latest(spark, sf):
    entries = d.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "ts")
    asked = d.table(spark, sf, "events").select(F.explode(F.array("event_type", d.s(F.col("event_type"), "_built"))).alias("key")).distinct()
    return src.meta_value(entries, asked, "none")


@query
def build_index(spark, sf):
    """Whole build: de-duplicate, gate, chunk, index, write; then count each written table."""
    root = _scratch(spark, "index")
    tables = index_tables(spark, sf)
    src.write_index(tables, root)
    counts = None
    for name in tables:
        one = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def cleaned_pages(spark, sf):
    docs = dedup.keep_first_copies(d.paged_documents(spark, sf))
    exploded = src.explode_pages(docs, ["doc_id", "relpath"])
    return docs, pages.with_page_status(pages.clean_pages(exploded, ["doc_id", "relpath", "page_number"]))


def index_tables(spark, sf):
    """documents, chunks, postings, doc_len and corpus_stats of the paged corpus."""
    docs, cleaned = cleaned_pages(spark, sf)
    cleaned = materialise(cleaned, "pages")
    chunks = materialise(chunking.number_chunks(chunking.chunk_pages(cleaned, ["doc_id"]), "doc_id"), "chunks")
    titled = chunks.join(docs.select("doc_id", "title"), "doc_id")
    columns = list(lx.PASSAGE_WEIGHTS)
    tokens = index.token_arrays(titled, columns)
    rolled = dedup.roll_up(docs.select("doc_id", "relpath", "category", "subcategory", "filename", "title", "sha256"),
                           cleaned, "relpath")
    return {
        "documents": rolled, "chunks": chunks, "postings": index.postings(tokens, columns),
        "doc_len": tokens.select("chunk_id", "dl"), "corpus_stats": index.corpus_stats(tokens),
    }


# --- text hygiene --------------------------------------------------------------------


def _varied_lines(spark, sf):
    return pages.explode_lines(d.varied_documents(spark, sf), ["doc_id"])


@query
def line_explode(spark, sf):
    return plain(_varied_lines(spark, sf))


@query
def script_class(spark, sf):
    lines = _varied_lines(spark, sf)
    return plain(lines.select("doc_id", "line_no", gate.script_class(F.col("line")).alias("script")))


def _counted_lines(spark, sf):
    return _varied_lines(spark, sf).select("doc_id", "line_no", counts_of_line(F.col("line")).alias("m"))


@query
def latin_score(spark, sf):
    return plain(_counted_lines(spark, sf).select("doc_id", "line_no", gate.latin_score_of(F.col("m")).alias("score")))


@query
def devanagari_score(spark, sf):
    return plain(_counted_lines(spark, sf).select("doc_id", "line_no", gate.devanagari_score_of(F.col("m")).alias("score")))


@query
def line_verdict(spark, sf):
    return plain(pages.judge_lines(_varied_lines(spark, sf)).drop("line", "stripped"))


def _cleaned(spark, sf):
    return pages.clean_pages(d.varied_documents(spark, sf), ["doc_id", "page_number"])


@query
def page_clean(spark, sf):
    return plain(_cleaned(spark, sf).drop("raw"))


@query
def page_status(spark, sf):
    return plain(pages.with_page_status(_cleaned(spark, sf)).drop("scripts", "dropped_reasons"))


@query
def drop_reasons(spark, sf):
    return plain(pages.drop_reasons(pages.with_page_status(_cleaned(spark, sf)), "doc_id"))


@query
def mojibake_fix(spark, sf):
    """Conversation text with broken and clean dashes put in."""
    k = F.col("conv_id") + F.col("turn")
    broken = F.when(k % 3 == 0, F.replace("text", F.lit(" "), F.lit(" â€” "))).when(
        k % 3 == 1, d.s("château ", F.col("text"))).otherwise(F.col("text"))
    return d.table(spark, sf, "conversations").select("conv_id", "turn", tx.fix_mojibake(broken).alias("fixed"))


# --- normalise, chunk, identifiers ----------------------------------------------------


@query
def text_normalise(spark, sf):
    noisy = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit(". ​ \t")), F.lit("\n"), F.lit("\n\n\n\n")), F.lit("the"), F.lit("th‍e"))
    return d.table(spark, sf, "documents").select("doc_id", tx.normalise(noisy).alias("normalised"))


@query
def clause_units(spark, sf):
    units = d.clause_pages(spark, sf).select("doc_id", F.posexplode(chunking.clause_units(tx.normalise(F.col("text")))).alias("pos", "unit"))
    return plain(units)


@query
def chunk_pages(spark, sf):
    return plain(chunking.chunk_pages(d.clause_pages(spark, sf), ["doc_id"]))


@query
def chunk_table(spark, sf):
    """Ordinals and joined identifiers over notices: one document per customer."""
    n = d.notices(spark, sf).join(
        d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), "o_orderkey"), "chunk_id")
    given = n.select("doc_id", F.col("o_orderkey").alias("page_number"), F.lit(0).alias("pos"), "text", "standard_ids", "gazette_ids")
    return plain(chunking.number_chunks(given, "doc_id").drop("chunk_id", "standard_ids", "gazette_ids"))


@query
def identifiers(spark, sf):
    return plain(d.notices(spark, sf).select("chunk_id", "standard_ids", "gazette_ids"))


@query
def identifier_index(spark, sf):
    return plain(index.identifier_index(d.notices(spark, sf)))


@query
def doc_title(spark, sf):
    name = d.s(F.replace("p_name", F.lit(" "), F.lit("-and_")), "__dup", F.col("p_partkey") % 5, "__", F.col("p_type"), ".v2.pdf")
    return d.table(spark, sf, "part").select("p_partkey", tx.title_of(name).alias("title"))


@query
def typed_identifiers(spark, sf):
    k = F.col("c_custkey")
    text = d.s("Is IS ", F.lit(300) + k, " clause ", k % 9 + 1, ".", k % 5, " met by CM/L ", F.lit(6300000000) + k,
               F.when(k % 2 == 0, d.s(" or R-", F.lit(10000000) + k)).otherwise(""), " with A1B", F.lit(100) + k % 900, "?")
    ids = d.table(spark, sf, "customer").select("c_custkey", F.explode(marks.typed_identifiers(text)).alias("i"))
    return ids.select("c_custkey", "i.kind", "i.value")


# --- de-duplication -------------------------------------------------------------------


@query
def exact_dedup(spark, sf):
    return plain(dedup.resolve_copies(dedup.content_hashes(d.corpus(spark, sf))))


@query
def doc_rollup(spark, sf):
    """Status counts of damaged pages: every sentence line of a varied document is a page."""
    varied = d.varied_documents(spark, sf).select("doc_id", F.replace("raw", F.lit(".\n"), F.lit(".\f")).alias("text"))
    status = pages.with_page_status(pages.clean_pages(src.explode_pages(varied, ["doc_id"]), ["doc_id", "page_number"]))
    return plain(dedup.roll_up(varied.select("doc_id"), status, "doc_id"))


@query
def ingest_upsert(spark, sf):
    """Documents fetched into a table that already holds the English ones."""
    docs = d.table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("source_name"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        "lang", F.when(F.col("doc_id") % 17 == 0, "timeout").alias("error"))
    existing = docs.where("lang = 'en'").select("source_name", "content_hash")
    batch = docs.drop("lang")
    return dedup.plan_ingest(batch, existing, ["source_name", "content_hash"]).select("row_id", "status")


@query
def rechunk_plan(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id")
    done = d.table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1).alias("version"))
    return dedup.plan_rechunk(docs, done, 2)


@query
def rechunk_apply(spark, sf):
    """The chunk table after a version bump: chunks of documents at the version stay, the others are cut anew."""
    docs = d.clause_pages(spark, sf)
    done = d.table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1).alias("version"))
    text = F.substring_index("text", "\n", 1)
    old = docs.join(done, "doc_id").select("doc_id", F.lit(1).alias("rules"), text.alias("text"))
    plan = dedup.plan_rechunk(docs.select("doc_id"), done, 2)
    fresh = docs.join(plan, "doc_id").select("doc_id", F.lit(2).alias("rules"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(
        "text <> ''").drop("pos")
    return plain(dedup.rechunked(old, plan, fresh))


@query
def ingest_totals(spark, sf):
    """Documents of ``ingest_upsert`` by status."""
    return dedup.ingest_summary(ingest_upsert(spark, sf))


# --- index ----------------------------------------------------------------------------


@query
def tokenise(spark, sf):
    return plain(d.table(spark, sf, "documents").select("doc_id", tx.search_tokens(F.col("text")).alias("tokens")))


@query
def postings(spark, sf):
    tokens = index.token_arrays(d.passages(spark, sf), list(lx.PASSAGE_WEIGHTS))
    return plain(index.postings(tokens, list(lx.PASSAGE_WEIGHTS)))


@query
def bm25_stats(spark, sf):
    return plain(index.corpus_stats(index.token_arrays(d.passages(spark, sf), list(lx.PASSAGE_WEIGHTS))))


@query
def embed_missing(spark, sf):
    docs = d.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    new = index.embed_missing(docs, d.vectors(spark, sf))
    return new.select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("v")).select(
        "chunk_id", F.array_join(F.transform("v", lambda x: F.format_number(x, 4)), " ").alias("embedding"))


@query
def l2_normalise(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    unit = d.table(spark, sf, "embeddings").select("vec_id", F.posexplode(index.l2_normalised(scaled)).alias("i", "x"))
    return plain(unit)


@query
def embed_coverage(spark, sf):
    docs = d.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    return plain(index.coverage(docs, d.vectors(spark, sf)))


# --- retrieval ------------------------------------------------------------------------


@query
def query_terms(spark, sf):
    return plain(retrieval.query_terms(d.benchmark_queries(spark, sf).unionByName(
        d.questions(spark, sf).select((F.col("query_id") + 1_000_000_000).alias("query_id"), "text"))).drop("terms"))


@query
def bm25_topk(spark, sf):
    hits = retrieval.keyword_search(d.passages(spark, sf), d.benchmark_queries(spark, sf), lx.TOP_K)
    return plain(hits.select("query_id", "rank", "chunk_id", "score"))


@query
def indexed_bm25_topk(spark, sf):
    """The index is built and written; the search reads nothing else."""
    root = _scratch(spark, "keyword-index")
    tables = retrieval.keyword_index(d.passages(spark, sf))
    src.write_index(tables, root)
    hits = retrieval.indexed_search(src.read_index(spark, root, list(tables)), d.benchmark_queries(spark, sf), lx.TOP_K)
    return plain(hits.select("query_id", "rank", "chunk_id", "score"))


def _documents_as_passages(spark, sf):
    return d.passages(spark, sf).withColumn("doc_id", F.col("chunk_id"))


@query
def bounded_bm25_topk(spark, sf):
    """A segment of all passages; blocks that cannot reach the k-th score stay closed."""
    root = _scratch(spark, "segments")
    segments.add(spark, root, _documents_as_passages(spark, sf))
    hits = bounded.bounded_search(segments.open_index(spark, root), d.benchmark_queries(spark, sf), lx.TOP_K)
    return plain(hits.select("query_id", "rank", "chunk_id", "score"))


@query
def segmented_bm25_topk(spark, sf):
    """Searches of an index between its changes: two additions (every fifth odd text a draft); drafts replaced and every seventh
    document deleted; all merged."""
    root, given = _scratch(spark, "segments"), _documents_as_passages(spark, sf)
    draft = (F.col("doc_id") % 2 == 1) & (F.col("doc_id") % 5 == 0)
    segments.add(spark, root, given.filter("doc_id % 2 = 0"))
    both = segments.add(spark, root, given.filter("doc_id % 2 = 1").withColumn("text", F.when(draft, d.s("draft of ", F.reverse("text"))).otherwise(F.col("text"))))
    segments.replace(spark, root, given.filter(draft))
    fewer = segments.delete(spark, root, given.filter("doc_id % 7 = 0"))
    merged = segments.merge(spark, root)
    out = None
    for state, version in enumerate((both, fewer, merged), 1):
        hits = bounded.bounded_search(segments.open_index(spark, root, version), d.benchmark_queries(spark, sf), lx.TOP_K)
        one = hits.select(F.lit(state).alias("state"), "query_id", "rank", "chunk_id", "score")
        out = one if out is None else out.unionByName(one)
    return plain(out)


@query
def indexed_hybrid_topk(spark, sf):
    root = _scratch(spark, "segments")
    segments.add(spark, root, _documents_as_passages(spark, sf))
    opened = segments.open_index(spark, root)
    hits = retrieval.search(d.passages(spark, sf), d.vectors(spark, sf), d.vector_queries(spark, sf), "hybrid",
                            keyword=lambda asked, k: bounded.bounded_search(opened, asked, k))
    return plain(hits.select("query_id", "rank", "chunk_id", "score", "keyword_rank", "semantic_rank"))


@query
def dense_topk(spark, sf):
    asked = d.vector_queries(spark, sf).where("embedding is not null")
    hits = retrieval.dense_search(d.vectors(spark, sf), asked, lx.TOP_K)
    return plain(hits.select("query_id", "rank", "chunk_id", "score"))


@query
def pruned_dense_topk(spark, sf):
    """The same hits from vectors written by pivots, without opening the blocks that cannot hold any."""
    cells = pivots.build(d.vectors(spark, sf))
    hits, _ = pivots.search(cells, d.vector_queries(spark, sf), lx.TOP_K)
    return plain(hits.select("query_id", "rank", "chunk_id", "score"))


@query
def rrf(spark, sf):
    """Fusion of two given rankings: parts per supplier by quantity and by price."""
    sold = d.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("chunk_id")).agg(
        F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    by_q = retrieval.top_k(sold.withColumn("score", F.col("q")), 60).select("query_id", "chunk_id", "rank")
    by_p = retrieval.top_k(sold.withColumn("score", F.col("p")), 60).select("query_id", "chunk_id", "rank")
    return plain(retrieval.reciprocal_rank_fusion(by_q.unionByName(by_p)))


def _identifier_questions(spark, sf):
    k = F.col("c_custkey")
    return d.table(spark, sf, "customer").select(k.alias("query_id"), d.s(
        "compare IS ", F.lit(300) + k, " with S.O. ", k % 5000, "(E) and IS ", F.lit(100) + k % 400).alias("text"))


@query
def identifier_boost(spark, sf):
    return plain(retrieval.identifier_matches(d.notices(spark, sf), _identifier_questions(spark, sf)))


@query
def exact_route(spark, sf):
    idx = index.identifier_index(d.notices(spark, sf))
    return plain(retrieval.exact_route(_identifier_questions(spark, sf), idx))


@query
def routed_topk(spark, sf):
    """Benchmark texts that name a standard, and some a clause of it: exact chunks first, searched ones after them."""
    k, notes = F.col("item_id"), d.notices(spark, sf)
    asked = d.table(spark, sf, "benchmark").select(k.alias("query_id"), d.s(
        F.col("text"), F.when(k % 3 != 0, d.s(" See IS ", F.lit(300) + k % 60)).otherwise(""),
        F.when(k % 3 == 1, d.s(", clause ", k % 9 + 1, ".", k % 4 + 1)).otherwise(""), F.lit(" about a licence")).alias("text"))
    hits = retrieval.search(notes, None, asked, "keyword")
    return plain(retrieval.exact_first(asked, index.identifier_index(notes), retrieval.clause_index(notes), hits))


@query
def hybrid_topk(spark, sf):
    hits = retrieval.search(d.passages(spark, sf), d.vectors(spark, sf), d.vector_queries(spark, sf), "hybrid")
    return plain(hits.select("query_id", "rank", "chunk_id", "score", "keyword_rank", "semantic_rank"))


def _hybrid_hits(spark, sf):
    queries = d.vector_queries(spark, sf)
    hits = retrieval.search(d.passages(spark, sf), d.vectors(spark, sf), queries, "hybrid")
    return retrieval.hydrate(hits, d.passages(spark, sf), queries.count() * lx.TOP_K)


@query
def hydrate_hits(spark, sf):
    return plain(_hybrid_hits(spark, sf).drop("keyword_score", "semantic_score", "source_url"))


@query
def hits_json(spark, sf):
    return plain(retrieval.serialise(_hybrid_hits(spark, sf)))


@query
def mode_overlap(spark, sf):
    p, v, q = d.passages(spark, sf), d.vectors(spark, sf), d.vector_queries(spark, sf)
    keyword = materialise(retrieval.keyword_search(p, q, lx.CANDIDATE_K), "keyword")
    semantic = materialise(retrieval.dense_search(v, q.where("embedding is not null"), lx.CANDIDATE_K), "semantic")
    hybrid = retrieval.fuse(keyword, semantic, retrieval.identifier_matches(p, q))
    first = F.col("rank") <= lx.TOP_K
    return plain(retrieval.mode_overlap(keyword.where(first), semantic.where(first), hybrid, q))


# --- code table -----------------------------------------------------------------------


@query
def tariff_by_code(spark, sf):
    return plain(tariff.by_code(d.tariff_questions(spark, sf), d.tariff(spark, sf)).select("query_id", "id", "hsn_cd", "product"))


@query
def tariff_by_product(spark, sf):
    asked = d.tariff_questions(spark, sf).select("query_id", tariff.product_query(F.col("text")).alias("text"))
    return plain(tariff.by_product(asked, d.tariff(spark, sf)))


@query
def tariff_mentions(spark, sf):
    return d.tariff_questions(spark, sf).select("query_id", tariff.mentions_tariff(F.col("text")).alias("mentions"))


@query
def tariff_code_extract(spark, sf):
    return d.tariff_questions(spark, sf).select("query_id", tariff.extract_code(F.col("text")).alias("code"))


@query
def tariff_query_clean(spark, sf):
    return d.tariff_questions(spark, sf).select("query_id", tariff.product_query(F.col("text")).alias("cleaned"))


@query
def tariff_lookup(spark, sf):
    return plain(tariff.lookup(d.tariff_questions(spark, sf), d.tariff(spark, sf)))


@query
def tariff_cards(spark, sf):
    table = d.tariff(spark, sf)
    coded = tariff.by_code(d.tariff_questions(spark, sf), table).select("query_id", "id", F.lit(1).alias("rank"))
    found = d.tariff_questions(spark, sf).select("query_id").join(coded, "query_id", "left").withColumn(
        "found", F.col("id").isNotNull())
    return tariff.cards(found, table, "en")


@query
def tariff_cards_hi(spark, sf):
    table = d.tariff(spark, sf)
    return plain(table.select("id", tariff.card("hi").alias("card")))


# --- marks and registry -----------------------------------------------------------------


@query
def decode_marks(spark, sf):
    return plain(marks.decode(d.marks(spark, sf)))


@query
def mark_kind_counts(spark, sf):
    return plain(marks.kind_counts(d.marks(spark, sf)))


@query
def verify_licences(spark, sf):
    return plain(marks.verify_licences(d.registry_asks(spark, sf), d.registry(spark, sf)))


def _scheme_matches(spark, sf):
    rules = spark.createDataFrame(d.SCHEME_KEYWORDS, "scheme string, keyword string")
    return marks.match_schemes(d.products(spark, sf), rules)


@query
def scheme_match(spark, sf):
    return _scheme_matches(spark, sf)


@query
def compliance_gaps(spark, sf):
    schemes = spark.createDataFrame(d.SCHEMES, "scheme string, mandatory boolean")
    return marks.compliance_gaps(_scheme_matches(spark, sf), schemes, d.held_licences(spark, sf))


# --- triage and context -----------------------------------------------------------------


def _asked(spark, sf):
    """Derived questions and the user turns of the conversations."""
    turns = d.table(spark, sf, "conversations").select(
        (F.lit(10_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return d.questions(spark, sf).select("query_id", "text").unionByName(turns)


def _turns(spark, sf):
    """Both kinds of conversations as turns."""
    made = d.questions(spark, sf).select((F.col("conv_id") + 1_000_000_000).alias("conv_id"), "turn", "role", "text")
    return d.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)


@query
def intent(spark, sf):
    return _asked(spark, sf).select("query_id", qf.intent(F.col("text")).alias("intent"))


@query
def stem_words(spark, sf):
    return plain(_asked(spark, sf).select("query_id", F.sort_array(qf.stem_words(F.col("text"))).alias("words")))


@query
def scope_gate(spark, sf):
    return _asked(spark, sf).select("query_id", qf.scope(F.col("text")).alias("s")).select("query_id", "s.*")


@query
def reply_language(spark, sf):
    preferred = d.pick([" HI ", "en", "xx"], F.col("query_id") % 3)
    return _asked(spark, sf).select("query_id", qf.reply_language(F.col("text"), preferred).alias("language"))


@query
def needs_context(spark, sf):
    return _asked(spark, sf).select("query_id", qf.needs_context(F.col("text")).alias("needs"))


@query
def expand_followups(spark, sf):
    return plain(context.expand_follow_ups(_turns(spark, sf)).drop("text"))


@query
def history_block(spark, sf):
    return plain(context.history_blocks(_turns(spark, sf)))


@query
def fixed_replies(spark, sf):
    asked = _asked(spark, sf).select("query_id", qf.intent(F.col("text")).alias("kind"), qf.reply_language(F.col("text")).alias("language"))
    return answers.fixed_replies(asked).select("query_id", "kind", "reply")


def _intent7(df):
    return qf.seven_intent(F.col("text"), marks.has_licence_identifier(F.col("text")))


@query
def intent7(spark, sf):
    named = d.marks(spark, sf).select((F.col("mark_id") + 20_000_000_000).alias("query_id"), d.s("what does ", F.upper("value"), " mean").alias("text"))
    asked = _asked(spark, sf).unionByName(named)
    return asked.select("query_id", _intent7(asked).alias("intent"))


# --- answers ----------------------------------------------------------------------------


def _question_batch(spark, sf):
    expanded = context.expand_follow_ups(d.questions(spark, sf)).select("conv_id", "turn", "text", "expanded")
    return expanded.select((F.col("conv_id") * 8 + F.col("turn")).alias("query_id"), "text", "expanded")


def _notice_hits(spark, sf):
    """Keyword hits of every question over the notices, hydrated; equal texts are searched once."""
    notes = d.notices(spark, sf)
    asked = d.questions(spark, sf).where("role = 'user'").select("query_id", "text")
    hits = materialise(
        retrieval.per_distinct_text(asked, lambda q: retrieval.search(notes, None, q, "keyword")), "notice-hits")
    return asked, retrieval.hydrate(hits, notes, asked.count() * lx.TOP_K)


@query
def relevance_gate(spark, sf):
    q = d.vector_queries(spark, sf)
    hits = retrieval.search(d.passages(spark, sf), d.vectors(spark, sf), q, "hybrid")
    both = answers.relevance_gate(q, hits).withColumn("mode", F.lit("hybrid"))
    only = answers.relevance_gate(q, retrieval.search(d.passages(spark, sf), None, q, "keyword")).withColumn("mode", F.lit("keyword"))
    return both.unionByName(only)


@query
def source_block(spark, sf):
    return answers.source_blocks(_notice_hits(spark, sf)[1])


@query
def extractive_answers(spark, sf):
    asked, hits = _notice_hits(spark, sf)
    asked = asked.withColumn("language", qf.reply_language(F.col("text")))
    return plain(answers.extractive_answers(asked, hits))


@query
def citation_check(spark, sf):
    checked = answers.check_citations(F.col("answer"), F.col("n_sources"))
    return plain(d.supplied_answers(spark, sf).select("query_id", checked.alias("c")).select("query_id", "c.*"))


@query
def grounding_check(spark, sf):
    return plain(answers.check_grounding(d.supplied_answers(spark, sf)))


@query
def strip_markers(spark, sf):
    return d.supplied_answers(spark, sf).select("query_id", answers.strip_markers(F.col("answer")).alias("answer"))


@query
def leaked_reasoning(spark, sf):
    return d.supplied_answers(spark, sf).select("query_id", qf.leaked_reasoning(F.col("answer")).alias("leaked"))


@query
def cited_sources(spark, sf):
    asked, hits = _notice_hits(spark, sf)
    asked = asked.withColumn("language", qf.reply_language(F.col("text")))
    return plain(answers.cited_sources(answers.extractive_answers(asked, hits), hits))


@query
def forced_refusals(spark, sf):
    asked, hits = _notice_hits(spark, sf)
    return answers.forced_refusals(asked, hits)


@query
def answer_batch(spark, sf):
    """Flagship: every derived question answered from the notices, follow-ups expanded."""
    return plain(answers.answer_batch(_question_batch(spark, sf), d.notices(spark, sf)))


def _document_search(spark, sf):
    """Keyword and dense rankings over written indexes of the documents."""
    root = _scratch(spark, "segments")
    segments.add(spark, root, _documents_as_passages(spark, sf))
    # Written once: the blocks read the vectors several times.
    vectors = materialise(d.document_vectors(spark, sf), "document-vectors")
    opened, cells = segments.open_index(spark, root), pivots.build(vectors)
    return {"keyword": lambda asked, k: bounded.bounded_search(opened, asked, k),
            "dense": lambda asked, k: pivots.search(cells, asked, k)[0]}


@query
def document_answers(spark, sf):
    """Conversations and benchmark texts answered from the whole documents by hybrid search over written indexes."""
    # Written once, dealt over all tasks: a filter on a vector would else be computed for every turn, in the one task that reads a small file.
    asked = materialise(d.document_questions(spark, sf), "questions")
    return plain(answers.answer_batch(asked, d.passages(spark, sf), None, "hybrid", **_document_search(spark, sf)))


@query
def verbatim_runs(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", "text")
    items = d.table(spark, sf, "benchmark").select("item_id", "text")
    return plain(overlap.verbatim_runs(docs, items, "doc_id", "item_id"))


@query
def verbatim_redact(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", "text")
    items = d.table(spark, sf, "benchmark").select("item_id", "text")
    runs = overlap.verbatim_runs(docs, items, "doc_id", "item_id").withColumn("clause", d.s("item ", F.col("item_id")))
    return plain(overlap.redact_runs(docs, runs, "doc_id", "clause"))


# --- routing ----------------------------------------------------------------------------


@query
def visible_questions(spark, sf):
    return plain(routing.visible_questions(d.cases(spark, sf)))


@query
def pathway_validate(spark, sf):
    return plain(routing.validate(d.cases(spark, sf)).drop("answers"))


@query
def pathway_route(spark, sf):
    return routing.route(d.cases(spark, sf))


@query
def next_question(spark, sf):
    return routing.next_question(d.cases(spark, sf))


@query
def pathway_steps(spark, sf):
    evidence = materialise(routing.step_evidence(spark, d.notices(spark, sf)), "evidence")
    steps = routing.pathways(routing.route(d.cases(spark, sf)), evidence)
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["relpath"], F.lit(" p."), c["page_number"].cast("string"))), "; ")
    return plain(steps.select("case_id", "scheme_code", "position", "title", "detail", cited.alias("citations")))


@query
def pathway_evidence(spark, sf):
    """The three best passages of each step by hybrid search, with their text."""
    notes = d.notices(spark, sf)
    vectors = materialise(notes.select("chunk_id", index.hashed_vector(F.col("text")).alias("embedding")), "notice-vectors")
    evidence = routing.step_evidence(spark, notes, vectors, "hybrid")
    return plain(evidence.select("step_list", "position", "title", "detail", F.explode_outer("citations").alias("c")).select(
        "step_list", "position", "title", "detail", "c.rank", "c.relpath", "c.page_number", "c.passage"))


# --- reports and evaluation ---------------------------------------------------------------


@query
def category_stats(spark, sf):
    """Customers as documents by nation, orders as chunks: the fan-out report."""
    docs = d.table(spark, sf, "customer").join(
        broadcast_if_small(d.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("doc_id"), F.col("n_name").alias("category"), (F.col("c_custkey") % 11 + 1).alias("page_count"),
             (F.col("c_custkey") % 3).alias("pages_scanned"), (F.col("c_custkey") % 4).alias("pages_corrupt"))
    chunks = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"))
    return plain(reports.category_stats(docs, chunks))


@query
def corpus_totals(spark, sf):
    c = F.col("c_custkey")
    docs = d.table(spark, sf, "customer").select(
        (c % 11 + 3).alias("page_count"), (c % 3).alias("pages_scanned"), (c % 2).alias("pages_corrupt"),
        (c % 11 + 3 - c % 3 - c % 2).alias("pages_ok"), F.when(c % 19 == 0, "broken").alias("error"))
    copies = dedup.resolve_copies(dedup.content_hashes(d.corpus(spark, sf)))
    return plain(reports.corpus_totals(docs, d.table(spark, sf, "orders"), copies))


@query
def index_health(spark, sf):
    return plain(reports.index_health(d.table(spark, sf, "customer"), d.table(spark, sf, "documents"), d.table(spark, sf, "embeddings")))


def _document_report(spark, sf):
    k = F.col("s_suppkey")
    sold = d.table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("pages_scanned"))
    return d.table(spark, sf, "supplier").join(sold, "s_suppkey", "left").select(
        d.s("suppliers/", F.col("s_name"), ".txt").alias("relpath"), F.coalesce("pages_scanned", F.lit(0)).alias("pages_scanned"),
        F.when(k % 7 == 0, "ValueError: damaged").alias("error"))


@query
def top_scanned(spark, sf):
    return plain(reports.top_scanned(_document_report(spark, sf)))


@query
def unreadable_docs(spark, sf):
    return reports.unreadable(_document_report(spark, sf))


def _eval_ranks(spark, sf):
    p, v, q = d.passages(spark, sf), d.vectors(spark, sf), d.vector_queries(spark, sf)
    keyword = materialise(retrieval.keyword_search(p, q, lx.CANDIDATE_K), "keyword")
    semantic = materialise(retrieval.dense_search(v, q.where("embedding is not null"), lx.CANDIDATE_K), "semantic")
    hybrid = retrieval.fuse(keyword, semantic, retrieval.identifier_matches(p, q))
    hits = None
    for mode, df in (("keyword", keyword), ("semantic", semantic), ("hybrid", hybrid)):
        one = df.where(F.col("rank") <= lx.TOP_K).select("query_id", F.lit(mode).alias("mode"), "rank", "chunk_id")
        hits = one if hits is None else hits.unionByName(one)
    # Hits are at most 3 x top-k per query; the paths of the passages are joined without text.
    hits = hits.join(p.select("chunk_id", "relpath"), "chunk_id")
    cases = q.select("query_id", d.s("SRC", F.col("query_id") % 20, "/").alias("expect_doc"),
                     F.explode(F.array(F.lit("keyword"), F.lit("semantic"), F.lit("hybrid"))).alias("mode"))
    return reports.expected_ranks(cases, hits)


@query
def retrieval_eval(spark, sf):
    return plain(reports.retrieval_scores(_eval_ranks(spark, sf)))


@query
def eval_misses(spark, sf):
    return plain(reports.misses(_eval_ranks(spark, sf)))


@query
def recall_at_k(spark, sf):
    """Questions naming a standard per nation, judged by the identifiers of their hits."""
    asked = d.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"), d.s("what about IS ", F.lit(300) + F.col("n_nationkey"), " and the licence fee").alias("text"),
        F.array(d.s("IS ", F.lit(300) + F.col("n_nationkey"))).alias("expected"))
    notes = d.notices(spark, sf)
    hits = materialise(retrieval.keyword_search(notes, asked, lx.TOP_K).select("query_id", "rank", "chunk_id"), "hits")
    found = notes.join(broadcast_if_small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    tagged = hits.join(found.select("chunk_id", "standard_ids"), "chunk_id")
    return plain(reports.recall_at_k(asked.select("query_id", "expected"), tagged, 5))


@query
def answer_metrics(spark, sf):
    asked = d.questions(spark, sf)
    k = F.col("query_id")
    predictions = asked.select("query_id", _intent7(asked).alias("intent"), (k % 3).alias("n_cited"), (k % 5 == 0).cast("int").alias("n_invalid"),
                               (k % 4 == 0).alias("forced_refusal"), (k % 101).cast("double").alias("latency_ms"))
    expected = ["standard_lookup", "out_of_scope", "out_of_scope", "out_of_scope", "out_of_scope", "out_of_scope", "process_howto"]
    golden = asked.select("query_id", d.pick(expected, k % len(expected)).alias("expected_intent"), (k % 2 == 0).alias("expects_citation"),
                          F.when(k % 6 == 0, True).alias("expects_refusal"))
    return plain(reports.answer_metrics(predictions, golden))


@query
def conversation_analytics(spark, sf):
    return plain(reports.conversation_analytics(d.messages(spark, sf)))


@query
def intent_distribution(spark, sf):
    return plain(reports.intent_distribution(d.messages(spark, sf)))


@query
def daily_usage(spark, sf):
    return plain(reports.daily_usage(d.calls(spark, sf)))


CAP = 300


@query
def cap_admission(spark, sf):
    return reports.admit_calls(d.calls(spark, sf), CAP).select("date", "id", "admitted")


@query
def cap_remaining(spark, sf):
    return plain(reports.admission_threshold(d.calls(spark, sf), CAP).select("date", "admitted_calls", "remaining"))


@query
def latest_feedback(spark, sf):
    ratings = d.table(spark, sf, "events").select(F.col("user_id").alias("message_id"), "ts", "event_id", (F.col("event_id") * 7 % 3 - 1).alias("rating"))
    return plain(reports.latest_feedback(ratings))


# --- web pages ----------------------------------------------------------------------------


def _web_pages(spark, sf):
    """Raw pages, every fifth with a table row; PDF rows come beside them under negative ids."""
    k = F.col("page_id")
    row = d.s("<table><tr><th>Page</th><th>Host</th></tr><tr><td>", k, "</td><td>", F.col("url"), "</td></tr></table></article>")
    pages = d.table(spark, sf, "pages").select("page_id", "url", "html")
    html = F.when(k % 5 == 0, F.replace("html", F.lit("</article>"), row)).otherwise(F.col("html"))
    pdf = pages.where(k % 10 == 9).select((-k).alias("page_id"), d.s("%PDF-1.7 ", F.col("html")).alias("html"))
    return pages.select("page_id", html.alias("html")).unionByName(pdf)


@query
def html_blocks(spark, sf):
    return plain(webpages.html_blocks(_web_pages(spark, sf)))


@query
def block_chunks(spark, sf):
    return plain(webpages.block_chunks(webpages.html_blocks(_web_pages(spark, sf))))


@query
def page_titles(spark, sf):
    return webpages.page_titles(d.table(spark, sf, "pages"))


# --- streaming ------------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: a pattern, since a stream takes no path of a single file."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def stream_ingest(spark, sf):
    root = _scratch(spark, "stream-ingest")
    jobs.ingest_documents(_stream(spark, sf, "documents").select("doc_id", "text"), f"{root}/chunks", f"{root}/cp").awaitTermination()
    return plain(spark.read.schema(jobs.CHUNK_SCHEMA).parquet(f"{root}/chunks").drop("chunk_id"))


@query
def stream_embed(spark, sf):
    root = _scratch(spark, "stream-embed")
    chunks = _stream(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    jobs.embed_chunks(chunks, f"{root}/vectors", f"{root}/cp").awaitTermination()
    return spark.read.schema(jobs.VECTOR_SCHEMA).parquet(f"{root}/vectors").select("chunk_id", F.size("embedding").cast("bigint").alias("dim"))


def _call_stream(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
        (F.get_json_object("props", "$.k").cast("bigint") - 20).alias("prompt_tokens"),
        (F.floor("value").cast("bigint") - 5).alias("completion_tokens"))


@query
def stream_daily_usage(spark, sf):
    root = _scratch(spark, "stream-usage")
    usage = jobs.daily_usage(_call_stream(spark, sf))
    jobs.keep_latest(usage, "date", f"{root}/out", f"{root}/cp").awaitTermination()
    return jobs.latest(spark, usage.schema, "date", f"{root}/out")


@query
def stream_cap(spark, sf):
    root = _scratch(spark, "stream-cap")
    jobs.admit_calls(_call_stream(spark, sf), f"{root}/out", f"{root}/state", f"{root}/cp", CAP).awaitTermination()
    return spark.read.schema("date date, ts timestamp, id bigint, admitted boolean").parquet(f"{root}/out").select("date", "id", "admitted")
