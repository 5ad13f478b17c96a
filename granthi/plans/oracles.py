"""ANSI SQL twins of the registered queries, for a second engine on the same tables."""

from __future__ import annotations

from granthi import lexicons as lx
from granthi.functions.questions import (
    PROCESS_WORDS, PRODUCT_WORDS, SAFETY_WORDS, SCHEME_WORDS, VERIFY_WORDS,
)
from granthi.plans import derived as d
from granthi.plans.queries import CAP

ORACLES: dict[str, str] = {}


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({lst(values)})[(({index})::BIGINT) + 1]"


DEV = "\u0900-\u097f"
STANDARD = (r"\bIS(?:\s*/\s*(?:IEC|ISO|EN))?\s*:?\s*\d{3,5}(?:\s*-\s*\d{1,2}\b)?"
            r"(?:\s*\(?\s*(?:Part|Pt\.?)\s*\d+\s*\)?)?(?:\s*[:\-]\s*(?:19|20)\d{2})?")
GAZETTE = r"(?i)\b(?:S\.?\s?O\.?|G\.?S\.?R\.?)\s*\.?\s*\d{1,5}\s*\(\s*E\s*\)"
TOKEN = r"[\p{L}\p{N}\x{E000}-\x{F8FF}]+"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower(regexp_replace({x}, '\p{{M}}', ' ', 'g'))), '{TOKEN}')"


def distinct_in_order(x: str) -> str:
    """First occurrences of a list, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def standards(x: str) -> str:
    one = f"list_transform(regexp_extract_all({x}, {lit(STANDARD)}), lambda m: trim(regexp_replace(upper({squeeze('m')}), '[:-]+$', '')))"
    return distinct_in_order(one)


def gazettes(x: str) -> str:
    return distinct_in_order(f"list_transform(regexp_extract_all({x}, {lit(GAZETTE)}), lambda m: upper({squeeze('m')}))")


def join(x: str) -> str:
    return f"array_to_string({x}, ' | ')"


TITLE = (r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(.)\.[^.]*$', '\1'), "
         r"'__dup\d*__?', ' ', 'g'), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g'))")

CORPUS = """corpus AS (SELECT doc_id, text, source || '/' || lang || '/doc_' || doc_id || '.txt' AS relpath,
 source AS category, lang AS subcategory, 'doc_' || doc_id || '.txt' AS filename, 'doc ' || doc_id AS title FROM documents)"""
PASSAGES = CORPUS + """,
passages AS (SELECT doc_id AS chunk_id, relpath, 1 AS page_number, title, category, text, '' AS is_numbers, '' AS gazette_refs FROM corpus)"""
QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
VECTORS = "vectors AS (SELECT vec_id AS chunk_id, embedding FROM embeddings)"
_K = "o_orderkey"
NOTICES = f"""noticed AS (SELECT o_orderkey AS chunk_id, (o_orderkey % 7 + 1) AS page_number, o_orderstatus AS category, o_custkey,
 'Order ' || {_K} || ' cites IS ' || (300 + o_custkey) || CASE WHEN {_K} % 3 = 0 THEN ' : ' || (1990 + {_K} % 30) ELSE '' END
 || CASE WHEN {_K} % 5 = 0 THEN ' and S.O. ' || ({_K} % 5000) || '(E)' ELSE '' END || '. ' || {pick(d.SUBJECTS, f'{_K} % {len(d.SUBJECTS)}')}
 || '; status ' || o_orderstatus || '. Clause ' || ({_K} % 9 + 1) || '.' || ({_K} % 4 + 1) || ' applies.' AS text FROM orders),
notices AS (SELECT *, 'notices/notice_' || chunk_id || '.txt' AS relpath, 'notice ' || chunk_id AS title,
 CASE WHEN chunk_id % 4 = 0 THEN 'https://example.org/n/' || chunk_id END AS source_url,
 {standards('text')} AS standard_ids, {gazettes('text')} AS gazette_ids,
 {join(standards('text'))} AS is_numbers, {join(gazettes('text'))} AS gazette_refs FROM noticed)"""
QUESTIONS = f"""questions AS (SELECT c_custkey AS query_id, c_custkey // 8 AS conv_id, c_custkey % 8 AS turn,
 CASE WHEN c_custkey % 8 = 3 THEN 'assistant' ELSE 'user' END AS role,
 replace({pick(d.QUESTION_TEMPLATES, f'c_custkey % {len(d.QUESTION_TEMPLATES)}')}, '{{n}}', (300 + c_nationkey)::VARCHAR) AS text FROM customer)"""
ASKED = QUESTIONS + """,
asked AS (SELECT query_id, text FROM questions UNION ALL
 SELECT 10000000000 + conv_id * 1000 + turn, text FROM conversations)"""
TURNS = QUESTIONS + """,
turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
 SELECT conv_id + 1000000000, turn, role, text FROM questions)"""


def phrases(source: str, name: str = "phrases") -> str:
    """Query phrases with multiplicity, as space-joined tokens."""
    syntax = lit('":^*(){}[]~/\\+,-')
    cleaned = f"translate(text, {syntax}, '{' ' * 16}')"
    return f"""words AS (SELECT query_id, text, list_filter(string_split_regex({cleaned}, '\\s+'), lambda t: length(t) > 1) AS w FROM {source}),
kept AS (SELECT query_id, text, w, list_filter(w, lambda t: NOT list_contains({lst(lx.QUERY_STOPWORDS)}, lower(t))) AS c FROM words),
raw_phrases AS (SELECT query_id, unnest(list_concat({standards('text')}, {gazettes('text')},
  CASE WHEN len(c) > 0 THEN c ELSE w END)) AS p FROM kept),
{name} AS (SELECT query_id, array_to_string({tokens('p')}, ' ') AS phrase, count(*)::BIGINT AS times
  FROM raw_phrases WHERE len({tokens('p')}) > 0 GROUP BY 1, 2)"""


def bm25(source: str, passages: str, weights: dict, grams: int = 1) -> str:
    """CTEs ending in scores(query_id, chunk_id, score)."""
    cols = list(weights)
    toks = ", ".join(f"{tokens('coalesce(' + c + ', chr(32))')} AS t_{c}" for c in cols)
    dl = " + ".join(f"len(t_{c})" for c in cols)
    parts = " UNION ALL ".join(
        f"SELECT chunk_id, dl, unnest(list_transform(range(1, len(t_{c}) - {n} + 2), lambda i: array_to_string(t_{c}[i:i + {n - 1}], ' '))) AS phrase, {float(w)}::DOUBLE AS w FROM toks"
        if n > 1 else f"SELECT chunk_id, dl, unnest(t_{c}) AS phrase, {float(w)}::DOUBLE AS w FROM toks"
        for c, w in weights.items() for n in range(1, grams + 1))
    return f"""{phrases(source)},
toks0 AS (SELECT chunk_id, {toks} FROM {passages}),
toks AS (SELECT *, {dl} AS dl FROM toks0),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM toks),
vocab AS (SELECT DISTINCT phrase FROM phrases),
grams AS ({parts}),
matches AS (SELECT g.phrase, chunk_id, sum(w) AS f, max(dl) AS dl FROM grams g JOIN vocab USING (phrase) GROUP BY 1, 2),
dfs AS (SELECT phrase, count(*) AS df FROM matches GROUP BY 1),
scores AS (SELECT query_id, chunk_id, sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE)
   * (f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
   FROM phrases JOIN dfs USING (phrase) JOIN matches USING (phrase), stats GROUP BY 1, 2)"""


def ranked(scores: str, k: int, name: str, ties: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {ties}chunk_id) AS rank
  FROM {scores}) WHERE rank <= {k})"""


# The dot product is summed in double precision like the other engine's.
DENSE = """dense AS (SELECT q.item_id AS query_id, v.chunk_id, list_dot_product(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
 FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, vectors v)"""

HYBRID = f"""WITH {PASSAGES}, {QUERIES}, {VECTORS}, {bm25('queries', 'passages', lx.PASSAGE_WEIGHTS)},
{ranked('scores', lx.CANDIDATE_K, 'kw')}, {DENSE}, {ranked('dense', lx.CANDIDATE_K, 'sem')},
fused AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + kw.rank), 0) + coalesce(1.0::DOUBLE / (60 + sem.rank), 0) AS score,
  kw.rank AS keyword_rank, sem.rank AS semantic_rank, sem.score AS semantic_score, kw.score AS keyword_score
  FROM kw FULL JOIN sem USING (query_id, chunk_id)),
{ranked('fused', lx.TOP_K, 'hybrid', 'keyword_rank NULLS LAST, semantic_rank NULLS LAST, ')}"""

ORACLES["bm25_topk"] = f"""WITH {PASSAGES}, {QUERIES}, {bm25('queries', 'passages', lx.PASSAGE_WEIGHTS)}, {ranked('scores', lx.TOP_K, 'hits')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits"""
ORACLES["indexed_bm25_topk"] = ORACLES["bm25_topk"]
ORACLES["bounded_bm25_topk"] = ORACLES["bm25_topk"]
ORACLES["indexed_hybrid_topk"] = f"{HYBRID} SELECT query_id, rank, chunk_id, round(score, 6) AS score, keyword_rank, semantic_rank FROM hybrid"
DRAFTS = """given AS (SELECT * REPLACE (CASE WHEN chunk_id % 2 = 1 AND chunk_id % 5 = 0 THEN 'draft of ' || reverse(text) ELSE text END AS text) FROM passages)"""
ALIVE = "given AS (SELECT * FROM passages WHERE chunk_id % 7 <> 0)"


def _state(states: str, given: str) -> str:
    """Top-k over one state of a changing index."""
    return f"""SELECT unnest({states}) AS state, query_id, rank, chunk_id, score FROM (WITH {PASSAGES}, {given}, {QUERIES},
{bm25('queries', 'given', lx.PASSAGE_WEIGHTS)}, {ranked('scores', lx.TOP_K, 'hits')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits)"""


ORACLES["segmented_bm25_topk"] = f"{_state('[1]', DRAFTS)} UNION ALL {_state('[2, 3]', ALIVE)}"
ORACLES["dense_topk"] = f"""WITH {VECTORS}, {DENSE}, {ranked('dense', lx.TOP_K, 'hits')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits"""
ORACLES["pruned_dense_topk"] = ORACLES["dense_topk"]
ORACLES["hybrid_topk"] = HYBRID + " SELECT query_id, rank, chunk_id, round(score, 6) AS score, keyword_rank, semantic_rank FROM hybrid"
_POSITION = "(row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank"
ORACLES["hydrate_hits"] = HYBRID + f""" SELECT query_id, {_POSITION}, chunk_id, round(score, 6) AS score, keyword_rank, semantic_rank,
 array_to_string(list_filter([CASE WHEN keyword_rank IS NOT NULL THEN 'keyword' END, CASE WHEN semantic_rank IS NOT NULL THEN 'semantic' END], lambda x: x IS NOT NULL), ' | ') AS sources,
 relpath, page_number::BIGINT AS page_number, title, category, text, relpath || ' p.' || page_number AS citation FROM hybrid JOIN passages USING (chunk_id)"""
ORACLES["query_terms"] = f"""WITH {QUESTIONS}, asked AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT query_id + 1000000000, text FROM questions),
{phrases('asked')} SELECT query_id, phrase, times FROM phrases"""
_TOP = f"(SELECT * FROM {{0}} WHERE rank <= {lx.TOP_K})"


def _ids(table: str, name: str) -> str:
    return f"{name} AS (SELECT query_id, list(chunk_id ORDER BY rank) AS {name}_ids FROM {table} WHERE rank <= {lx.TOP_K} GROUP BY 1)"


ORACLES["mode_overlap"] = HYBRID + f""", {_ids('kw', 'k')}, {_ids('sem', 's')}, {_ids('hybrid', 'h')},
sets AS (SELECT query_id, coalesce(k_ids, []) AS k, coalesce(s_ids, []) AS s, coalesce(h_ids, []) AS h FROM queries
 LEFT JOIN k USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN h USING (query_id))
SELECT query_id, {join('list_sort(list_filter(k, lambda x: NOT list_contains(s, x)))')} AS keyword_only,
 {join('list_sort(list_filter(s, lambda x: NOT list_contains(k, x)))')} AS semantic_only,
 {join('list_sort(list_filter(k, lambda x: list_contains(s, x)))')} AS found_by_both,
 {join('list_filter(h, lambda x: NOT list_contains(k, x) AND NOT list_contains(s, x))')} AS hybrid_unique FROM sets"""
_RANKS = HYBRID + """, hits AS (SELECT query_id, 'keyword' AS mode, rank, chunk_id FROM kw WHERE rank <= 8
 UNION ALL SELECT query_id, 'semantic', rank, chunk_id FROM sem WHERE rank <= 8 UNION ALL SELECT query_id, 'hybrid', rank, chunk_id FROM hybrid),
cases AS (SELECT query_id, 'SRC' || (query_id % 20) || '/' AS expect_doc, unnest(['keyword', 'semantic', 'hybrid']) AS mode FROM queries),
found AS (SELECT c.query_id, c.mode, min(rank) AS rank FROM cases c JOIN hits h ON h.query_id = c.query_id AND h.mode = c.mode JOIN passages p USING (chunk_id)
 WHERE contains(lower(p.relpath), lower(c.expect_doc)) GROUP BY 1, 2),
ranks AS (SELECT c.*, f.rank FROM cases c LEFT JOIN found f USING (query_id, mode))"""
ORACLES["retrieval_eval"] = _RANKS + """ SELECT mode, count(*) AS cases, round(avg((rank IS NOT NULL)::INT), 6) AS hit_at_k,
 round(avg(coalesce((rank = 1)::INT, 0)), 6) AS hit_at_1, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM ranks GROUP BY 1"""
ORACLES["eval_misses"] = _RANKS + " SELECT query_id, expect_doc FROM ranks WHERE mode = 'hybrid' AND rank IS NULL"
_GATE = """SELECT query_id, {mode} AS mode, coalesce(CASE WHEN cosine IS NOT NULL THEN round(cosine, 9) >= 0.5 ELSE round(first_score, 9) >= 2.0 END, false) AS passed,
 CASE WHEN first_score IS NULL THEN 'no matching passage' WHEN CASE WHEN cosine IS NOT NULL THEN round(cosine, 9) >= 0.5 ELSE round(first_score, 9) >= 2.0 END THEN ''
  WHEN cosine IS NOT NULL THEN 'below the cosine floor' ELSE 'below the keyword floor' END AS gate_reason
 FROM queries LEFT JOIN (SELECT query_id, {cosine} AS cosine, min_by(score, rank) AS first_score FROM {hits} GROUP BY 1) USING (query_id)"""
ORACLES["relevance_gate"] = HYBRID + " " + _GATE.format(mode="'hybrid'", cosine="max(semantic_score)", hits="hybrid") + " UNION ALL " + _GATE.format(
    mode="'keyword'", cosine="max(NULL::DOUBLE)", hits="kw")
ORACLES["rrf"] = f"""WITH sold AS (SELECT l_suppkey AS query_id, l_partkey AS chunk_id, sum(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
{ranked('(SELECT query_id, chunk_id, q AS score FROM sold)', 60, 'a')}, {ranked('(SELECT query_id, chunk_id, p AS score FROM sold)', 60, 'b')}
SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM a UNION ALL SELECT query_id, chunk_id, rank FROM b) GROUP BY 1, 2"""
IDQ = """idq AS (SELECT c_custkey AS query_id, 'compare IS ' || (300 + c_custkey) || ' with S.O. ' || (c_custkey % 5000) || '(E) and IS ' || (100 + c_custkey % 400) AS text FROM customer)"""
ORACLES["identifier_boost"] = f"""WITH {NOTICES}, {IDQ}, wl AS (SELECT query_id, list_concat({standards('text')}, {gazettes('text')}) AS w FROM idq),
wanted AS (SELECT query_id, unnest(w) AS identifier, unnest(range(0, len(w))) AS nth FROM wl),
found AS (SELECT identifier, chunk_id, row_number() OVER (PARTITION BY identifier ORDER BY page_number, chunk_id) AS seq
 FROM (SELECT DISTINCT identifier FROM wanted), notices WHERE contains(is_numbers, identifier) OR contains(gazette_refs, identifier))
SELECT query_id, chunk_id, min(nth * 8 + seq) AS boost_pos FROM wanted JOIN found USING (identifier) WHERE seq <= 8 GROUP BY 1, 2"""
ORACLES["exact_route"] = f"""WITH {NOTICES}, {IDQ}, idx AS (SELECT DISTINCT unnest(list_concat(standard_ids, gazette_ids)) AS identifier, chunk_id, page_number FROM notices),
wanted AS (SELECT query_id, unnest(list_concat({standards('text')}, {gazettes('text')})) AS identifier FROM idq),
best AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY page_number, chunk_id) AS position FROM idx)
SELECT query_id, identifier, chunk_id, position, 'exact' AS route FROM wanted JOIN best USING (identifier) WHERE position <= 8"""

# --- sources
ORACLES["corpus_paths"] = f"""WITH paths AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS relpath FROM documents
 UNION ALL SELECT '_meta/item_' || item_id || '.txt' FROM benchmark UNION ALL SELECT 'labels/Quality-List__dup2__' || doc_id || '.csv' FROM labels),
p AS (SELECT relpath, string_split(relpath, '/') AS parts FROM paths)
SELECT relpath, parts[1] AS category, CASE WHEN len(parts) > 2 THEN parts[2] ELSE '' END AS subcategory, parts[-1] AS filename,
 {TITLE.format('parts[-1]')} AS title FROM p WHERE parts[1] <> '_meta'"""
ORACLES["page_explode"] = r"""WITH p AS (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(12)), chr(12)) AS x FROM documents)
SELECT doc_id, unnest(range(1, len(x) + 1)) AS page_number, unnest(x) AS raw FROM p"""
PROV = """log AS (SELECT CASE WHEN page_id % 9 = 0 THEN '' ELSE 'doc_' || (page_id % 100) || '.txt' END AS filename,
 CASE WHEN page_id % 7 = 0 THEN '' ELSE url END AS source_url, page_id FROM pages),
urls AS (SELECT filename, max_by(source_url, page_id) AS source_url FROM log WHERE filename <> '' AND source_url <> '' GROUP BY 1)"""
ORACLES["source_urls"] = f"WITH {PROV} SELECT filename, source_url FROM urls"
ORACLES["source_url_join"] = f"WITH {PROV}, {CORPUS} SELECT doc_id, c.filename, source_url FROM corpus c LEFT JOIN urls u ON u.filename = c.filename"
_PN = "p_name"
TARIFF_CELLS = f"""tariff0 AS (SELECT p_partkey AS id, (1010 + p_partkey)::VARCHAR AS hsn_cd, {pick(d.LEVELS, 'p_size % 4')} AS level, (p_partkey % 97)::VARCHAR AS chapter,
 p_type AS chapter_title, p_brand AS heading, CASE WHEN p_partkey % 10 = 3 THEN replace(p_name, ' ', ' — ') WHEN p_partkey % 50 = 7 THEN NULL ELSE p_name END AS product,
 CASE WHEN p_partkey % 4 <> 0 THEN 'Invoice for ' || p_name END AS import_core_docs, CASE WHEN p_partkey % 3 <> 0 THEN 'Mark on ' || p_name END AS import_bis_is,
 CASE WHEN p_partkey % 2 = 0 THEN 'Free' ELSE 'Restricted' END AS import_dgft_policy, CASE WHEN p_partkey % 6 = 0 THEN 'Yes' END AS import_licence_required,
 NULL::VARCHAR AS import_monitoring_system, CASE WHEN p_partkey % 5 <> 0 THEN 'Origin of ' || p_name END AS import_coo, NULL::VARCHAR AS import_other_noc,
 CASE WHEN p_partkey % 7 <> 0 THEN 'Packing list of ' || p_name END AS export_core_docs, 'Free' AS export_dgft_policy,
 CASE WHEN p_partkey % 9 = 0 THEN 'NOC' END AS export_other_noc, CASE WHEN p_partkey % 3 = 0 THEN 'Regulator A' END AS primary_regulator,
 CASE WHEN p_partkey % 8 = 0 THEN 'Portal' END AS verify_against FROM part),
tariff AS (SELECT * FROM tariff0 WHERE product IS NOT NULL)"""
ORACLES["tariff_load"] = f"WITH {TARIFF_CELLS} SELECT * EXCLUDE (id) FROM tariff"
ORACLES["golden_cases"] = """SELECT text AS question, 'src' || (item_id % 20) || '/' AS expect_doc, CASE WHEN item_id % 3 = 0 THEN 'checked' ELSE '' END AS note,
 CASE WHEN item_id % 4 = 0 THEN 'hi' ELSE 'en' END AS language FROM benchmark"""
ORACLES["run_meta_latest"] = """WITH keys AS (SELECT DISTINCT event_type AS key FROM events UNION SELECT DISTINCT event_type || '_built' FROM events),
m AS (SELECT event_type AS key, props AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, props DESC NULLS LAST) = 1) SELECT key, coalesce(value, 'none') AS value FROM keys LEFT JOIN m USING (key)"""

# --- gate
VARIED = f"""varied AS (SELECT doc_id, CASE doc_id % 7
 WHEN 1 THEN translate(lower(text), '{d.LATIN_LETTERS}', '{d.DEVANAGARI_LETTERS}') WHEN 2 THEN replace(text, ' ', ' मानक ')
 WHEN 3 THEN '/uni0909 ' || text WHEN 4 THEN regexp_replace(text, '[aeiou]', '', 'g') WHEN 5 THEN replace(text, 'th', 'tH')
 WHEN 6 THEN replace(text, ',', ' भारतीय मानक ब्यूरो का आदेश ') || chr(10) || '12 34' || chr(10) || 'ab' || chr(10) || chr(10) || '(cid:7) glyph' ELSE text END AS raw FROM documents)"""
LINES = VARIED + """,
split_lines AS (SELECT doc_id, string_split(raw, chr(10)) AS x0 FROM varied),
trimmed_lines AS (SELECT doc_id, CASE WHEN x0[-1] = '' THEN x0[1:len(x0) - 1] ELSE x0 END AS x FROM split_lines),
lines AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM trimmed_lines)"""
_TOK = rf"list_filter(string_split_regex(s, '[^\p{{L}}\p{{N}}_{DEV}]+'), lambda t: t <> '')"


def _match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def _n(x: str) -> str:
    return f"len({x})"


def _counted(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


COMBINING, CONSONANT = "ऺ-ॏ॑-ॗॢॣ", "क-हक़-य़ॸ-ॿ"
_INTRUSION = rf"[{DEV}][\[\]\\/{{}}<>@#$%^&*|~`A-Za-z][{DEV}]"


def scored(source: str) -> str:
    """CTEs over source(doc_id, line_no, s) ending in gate(…, script, ls, ds)."""
    return f"""t0 AS (SELECT *, {_TOK} AS tok, {_counted('s', f'[{DEV}]')} AS dev_n, {_counted('s', '[A-Za-z]')} AS lat_n FROM {source}),
t1 AS (SELECT *, list_transform(list_filter(tok, lambda t: {_match('t', '[A-Za-z]')}), lambda t: lower(t)) AS lat,
 list_filter(tok, lambda t: {_match('t', f'[{DEV}]')}) AS dev,
 CASE WHEN dev_n = 0 AND lat_n = 0 THEN 'neutral' WHEN dev_n = 0 THEN 'latin' WHEN lat_n = 0 THEN 'devanagari'
  WHEN dev_n / (dev_n + lat_n) >= 0.75 THEN 'devanagari' WHEN lat_n / (dev_n + lat_n) >= 0.75 THEN 'latin' ELSE 'mixed' END AS script FROM t0),
t2 AS (SELECT *, list_filter(lat, lambda t: length(t) >= 3 AND NOT {_match('t', '^[ivxlcdm]+$')}) AS judged,
 {_counted(f"regexp_replace(s, '[A-Za-z{DEV}]', '', 'g')", '[' + chr(92) + 'p{L}]')} / greatest(length(s), 1) AS exotic,
 list_filter(dev, lambda t: length(t) BETWEEN 2 AND 4) AS short FROM t1),
t3 AS (SELECT *, len(lat) AS n, len(list_filter(lat, lambda t: list_contains({lst(lx.GATE_STOPWORDS)}, t))) AS stop,
 len(list_filter(lat, lambda t: {_match('t', '[aeiouy]')} OR list_contains({lst(lx.ALLOWED_SHORT)}, t))) / len(lat) AS vr,
 CASE WHEN len(judged) > 0 THEN len(list_filter(judged, lambda t: NOT {_match('t', '[aeiouy]')})) / len(judged) ELSE 0.0::DOUBLE END AS nv,
 len(list_filter(tok, lambda t: {_match('t', '[a-z][A-Z]')})) / len(lat) AS caps,
 len(dev) AS dn, len(list_filter(dev, lambda t: {_match('t', '[A-Za-z]')})) / len(dev) AS fused, {_counted('s', _INTRUSION)} AS intr,
 len(list_filter(dev, lambda t: length(t) = 1)) / len(dev) AS singles,
 len(list_filter(range(2, len(dev) + 1), lambda i: dev[i] = dev[i - 1] AND length(dev[i]) > 1)) / greatest(len(dev) - 1, 1) AS runs,
 ({_counted('s', f'[{COMBINING}]+')} - {_counted('s', f'[{CONSONANT}][{COMBINING}]+')}) / greatest(dev_n, 1) AS orphans,
 coalesce(list_max(list_transform(list_distinct(short), lambda u: len(list_filter(short, lambda v: v = u)))), 0) / len(dev) AS rep FROM t2),
gate AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, vr - CASE WHEN n >= 6 AND stop = 0 THEN 0.35::DOUBLE ELSE 0 END
  - CASE WHEN exotic > 0.01 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN nv > 0.15 THEN least(0.6::DOUBLE, nv * 1.6::DOUBLE) ELSE 0 END - CASE WHEN caps > 0.05 THEN 0.35::DOUBLE ELSE 0 END)) END AS ls,
 CASE WHEN dn = 0 THEN 1.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - CASE WHEN fused > 0.05 THEN least(0.6::DOUBLE, fused * 3) ELSE 0 END
  - CASE WHEN intr > 0 THEN least(0.6::DOUBLE, 0.25::DOUBLE + 0.15::DOUBLE * intr) ELSE 0 END - CASE WHEN dn >= 8 AND singles > 0.2 THEN least(0.6::DOUBLE, singles * 1.5::DOUBLE) ELSE 0 END
  - CASE WHEN runs > 0.12 THEN least(0.5::DOUBLE, runs * 2) ELSE 0 END - CASE WHEN orphans > 0.04 THEN least(0.5::DOUBLE, orphans * 5) ELSE 0 END
  - CASE WHEN dn >= 8 AND rep > 0.22 THEN least(0.5::DOUBLE, rep) ELSE 0 END)) END AS ds FROM t3)"""


_RAW = "raw_lines AS (SELECT doc_id, line_no, line AS s FROM lines)"
ORACLES["line_explode"] = f"WITH {LINES} SELECT doc_id, line_no, line FROM lines"
ORACLES["script_class"] = f"WITH {LINES}, {_RAW}, {scored('raw_lines')} SELECT doc_id, line_no, script FROM gate"
ORACLES["latin_score"] = f"WITH {LINES}, {_RAW}, {scored('raw_lines')} SELECT doc_id, line_no, round(ls, 6) AS score FROM gate"
ORACLES["devanagari_score"] = f"WITH {LINES}, {_RAW}, {scored('raw_lines')} SELECT doc_id, line_no, round(ds, 6) AS score FROM gate"
VERDICT = f"""stripped AS (SELECT doc_id, line_no, trim(line) AS s FROM lines), {scored('stripped')},
v0 AS (SELECT *, length(s) < 3 AS short_line, {_match('s', r'/uni[0-9A-Fa-f]{4}|/g' + chr(92) + r'd+|' + chr(92) + r'(cid:' + chr(92) + r'd+' + chr(92) + ')')} AS unmapped FROM gate),
v1 AS (SELECT *, CASE WHEN short_line OR unmapped OR script = 'neutral' THEN 0.0 WHEN script = 'latin' THEN ls WHEN script = 'devanagari' THEN ds ELSE least(ls, ds) END AS score FROM v0),
verdicts AS (SELECT doc_id, line_no, s, CASE WHEN short_line THEN 'neutral' ELSE script END AS script, score, CASE WHEN score >= 0.6 THEN 'keep' ELSE 'reject' END AS verdict,
 CASE WHEN short_line THEN 'too short' WHEN unmapped THEN 'unmapped glyph escapes' WHEN script = 'neutral' THEN 'no letters'
  WHEN script = 'latin' OR (script = 'mixed' AND ls <= ds) THEN CASE WHEN n = 0 THEN 'no latin words to judge' WHEN ls < 0.55 THEN 'latin gibberish' ELSE 'ok' END
  ELSE CASE WHEN dn = 0 THEN 'no devanagari words to judge' WHEN ds < 0.6 THEN 'devanagari corruption' ELSE 'ok' END END AS reason FROM v1)"""
ORACLES["line_verdict"] = f"WITH {LINES}, {VERDICT} SELECT doc_id, line_no, script, round(score, 6) AS score, verdict, reason FROM verdicts"


def page_sql(key: str) -> str:
    """CTEs over verdicts grouped by key, ending in status."""
    return f"""hist AS (SELECT {key}, verdict, CASE WHEN verdict = 'keep' THEN script ELSE reason END AS label, count(*) AS c FROM verdicts GROUP BY ALL),
hists AS (SELECT {key}, coalesce(string_agg(label || ':' || c, '; ' ORDER BY label) FILTER (verdict = 'keep'), '') AS scripts,
 coalesce(string_agg(label || ':' || c, '; ' ORDER BY label) FILTER (verdict = 'reject'), '') AS dropped_reasons FROM hist GROUP BY ALL),
clean AS (SELECT {key}, coalesce(string_agg(s, chr(10) ORDER BY line_no) FILTER (verdict = 'keep'), '') AS kept_text,
 count(*) FILTER (verdict = 'keep') AS kept_lines, count(*) FILTER (verdict = 'reject') AS dropped_lines FROM verdicts GROUP BY ALL),
status0 AS (SELECT v.*, coalesce(kept_text, '') AS kept_text, coalesce(kept_lines, 0) AS kl, coalesce(dropped_lines, 0) AS dl, coalesce(dl / (kl + dl), 0.0) AS dr,
  length(trim(v.raw, chr(10) || ' ')) AS rl FROM page_rows v LEFT JOIN clean USING ({key})),
status AS (SELECT *, CASE WHEN rl = 0 THEN 'scanned' WHEN rl < 80 THEN 'empty' WHEN dr > 0.7 THEN 'mostly_corrupt' WHEN length(trim(kept_text, chr(10) || ' ')) < 80 THEN 'empty' ELSE 'ok' END AS status FROM status0)"""


_PAGE_ROWS = "page_rows AS (SELECT doc_id, raw FROM varied)"
ORACLES["page_clean"] = f"""WITH {LINES}, {VERDICT}, {_PAGE_ROWS}, {page_sql('doc_id')} SELECT doc_id, 1::BIGINT AS page_number, kept_text, kl AS kept_lines, dl AS dropped_lines,
 round(dr, 6) AS drop_ratio, coalesce(dropped_reasons, '') AS dropped_reasons, coalesce(scripts, '') AS scripts FROM status LEFT JOIN hists USING (doc_id)"""
ORACLES["page_status"] = f"""WITH {LINES}, {VERDICT}, {_PAGE_ROWS}, {page_sql('doc_id')} SELECT doc_id, 1::BIGINT AS page_number, status, CASE WHEN status = 'ok' THEN kept_text ELSE '' END AS text,
 CASE WHEN rl < 80 THEN 0 ELSE kl END AS kept_lines, CASE WHEN rl < 80 THEN 0 ELSE dl END AS dropped_lines, CASE WHEN rl < 80 THEN 1.0 ELSE round(dr, 6) END AS drop_ratio FROM status"""
ORACLES["drop_reasons"] = f"""WITH {LINES}, {VERDICT}, {_PAGE_ROWS}, {page_sql('doc_id')} SELECT doc_id, reason, count(*) AS lines FROM verdicts JOIN status USING (doc_id)
 WHERE verdict = 'reject' AND rl >= 80 GROUP BY 1, 2"""
ORACLES["doc_rollup"] = f"""WITH {VARIED}, pages0 AS (SELECT doc_id, string_split(replace(raw, '.' || chr(10), '.' || chr(12)), chr(12)) AS x FROM varied),
page_rows AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS page_number, unnest(x) AS raw FROM pages0),
pl AS (SELECT doc_id, page_number, string_split(raw, chr(10)) AS x0 FROM page_rows),
pl2 AS (SELECT doc_id, page_number, CASE WHEN x0[-1] = '' THEN x0[1:len(x0) - 1] ELSE x0 END AS x FROM pl),
lines AS (SELECT doc_id, page_number, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM pl2),
{VERDICT.replace('SELECT doc_id, line_no', 'SELECT doc_id, page_number, line_no')}, {page_sql('doc_id, page_number')}
SELECT doc_id, count(*) AS page_count, count(*) FILTER (status = 'ok') AS pages_ok, count(*) FILTER (status = 'scanned') AS pages_scanned,
 count(*) FILTER (status = 'mostly_corrupt') AS pages_corrupt FROM status GROUP BY 1"""
ORACLES["mojibake_fix"] = """SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN replace(text, ' ', CASE WHEN strlen(text) = length(text) THEN ' — ' ELSE ' â€” ' END) WHEN 1 THEN 'château ' || text ELSE text END AS fixed FROM conversations"""

# --- normalise and identifiers
ORACLES["text_normalise"] = r"""SELECT doc_id, trim(regexp_replace(replace(text, '. ', '. '), '\n', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS normalised FROM documents"""
ORACLES["chunk_table"] = f"""WITH {NOTICES} SELECT o_custkey AS doc_id, chunk_id AS page_number, row_number() OVER (PARTITION BY o_custkey ORDER BY chunk_id) - 1 AS ordinal,
 text, is_numbers, gazette_refs FROM notices"""
ORACLES["identifiers"] = f"WITH {NOTICES} SELECT chunk_id, is_numbers AS standard_ids, gazette_refs AS gazette_ids FROM notices"
ORACLES["identifier_index"] = f"WITH {NOTICES} SELECT DISTINCT unnest(list_concat(standard_ids, gazette_ids)) AS identifier, chunk_id, page_number FROM notices"
_NAME = "replace(p_name, ' ', '-and_') || '__dup' || (p_partkey % 5) || '__' || p_type || '.v2.pdf'"
ORACLES["doc_title"] = f"SELECT p_partkey, {TITLE.format(_NAME)} AS title FROM part"
ORACLES["typed_identifiers"] = """SELECT c_custkey, 'standard' AS kind, 'IS ' || left((300 + c_custkey)::VARCHAR, 5) AS value FROM customer
UNION ALL SELECT c_custkey, 'clause', 'CLAUSE ' || (c_custkey % 9 + 1) || '.' || (c_custkey % 5) FROM customer
UNION ALL SELECT c_custkey, 'licence', 'CM/L ' || (6300000000 + c_custkey) FROM customer
UNION ALL SELECT c_custkey, 'crs', 'R-' || (10000000 + c_custkey) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'hallmark', 'A1B' || (100 + c_custkey % 900) FROM customer"""

# --- de-duplication
ORACLES["exact_dedup"] = f"""WITH {CORPUS}, h AS (SELECT relpath, sha256(text) AS sha256 FROM corpus)
SELECT relpath, sha256, min(relpath) OVER (PARTITION BY sha256) AS kept_path, count(*) OVER (PARTITION BY sha256) AS copies,
 relpath = min(relpath) OVER (PARTITION BY sha256) AS is_kept FROM h"""
ORACLES["ingest_upsert"] = """WITH docs AS (SELECT doc_id AS row_id, source, sha256(text) AS h, lang, doc_id % 17 = 0 AS failed FROM documents),
firsts AS (SELECT source, h, min(row_id) AS first_id FROM docs WHERE NOT failed GROUP BY 1, 2),
known AS (SELECT DISTINCT source, h FROM docs WHERE lang = 'en')
SELECT row_id, CASE WHEN failed THEN 'failed' WHEN k.h IS NOT NULL THEN 'unchanged' WHEN row_id = first_id THEN 'created' ELSE 'skipped' END AS status
FROM docs d LEFT JOIN firsts f ON f.source = d.source AND f.h = d.h LEFT JOIN known k ON k.source = d.source AND k.h = d.h"""
ORACLES["rechunk_plan"] = """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'regenerate' ELSE 'create' END AS action
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.quality + 1 <> 2"""
ORACLES["ingest_totals"] = f"SELECT status, count(*) AS documents FROM ({ORACLES['ingest_upsert']}) GROUP BY 1"
ORACLES["rechunk_apply"] = r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\n([A-Z])', chr(10) || '(a) \1', 'g'),
  '\. ([OTE])', '.' || chr(10) || '4.2 \1', 'g'), chr(10)) AS x FROM documents),
current AS (SELECT doc_id FROM labels WHERE quality + 1 = 2)
SELECT doc_id, 1 AS rules, x[1] AS text FROM p SEMI JOIN current USING (doc_id)
UNION ALL SELECT * FROM (SELECT doc_id, 2, unnest(x) AS text FROM p ANTI JOIN current USING (doc_id)) WHERE text <> ''"""

# --- index
ORACLES["tokenise"] = f"SELECT doc_id, {join(tokens('text'))} AS tokens FROM documents"
_TT = f"toks AS (SELECT chunk_id, {tokens('text')} AS text, {tokens('title')} AS title FROM passages)"
ORACLES["postings"] = f"""WITH {PASSAGES}, {_TT} SELECT unnest(text) AS term, chunk_id, 'text' AS col, unnest(range(0, len(text))) AS pos FROM toks
UNION ALL SELECT unnest(title), chunk_id, 'title', unnest(range(0, len(title))) FROM toks"""
ORACLES["bm25_stats"] = f"WITH {PASSAGES}, {_TT} SELECT count(*) AS n_chunks, round(avg(len(text) + len(title)), 6) AS avgdl FROM toks"
ORACLES["embed_missing"] = f"""WITH slots AS (SELECT doc_id AS chunk_id, list_transform({tokens('text')}, lambda t: ('0x' || left(md5(t), 7))::INT % 64) AS s FROM documents d
 WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)),
counts AS (SELECT chunk_id, list_transform(range(0, 64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS c FROM slots),
norms AS (SELECT *, sqrt(list_dot_product(c, c)) AS norm FROM counts)
SELECT chunk_id, array_to_string(list_transform(c, lambda x: format('{{:.4f}}', round((CASE WHEN norm > 0 THEN x / norm ELSE 0 END)::FLOAT::DOUBLE, 5))), ' ') AS embedding FROM norms"""
ORACLES["l2_normalise"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 2)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v) SELECT vec_id, unnest(range(0, len(e))) AS i, round(unnest(e) / norm, 6) AS x FROM n"""
ORACLES["embed_coverage"] = """SELECT count(v.vec_id) AS embedded, count(*) AS chunks, round(count(v.vec_id) / count(*), 6) AS coverage
FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = d.doc_id"""

# --- code table
_ADJ, _NOUN = ["red", "blue", "hot", "cold", "old", "new", "small", "large"], ["bolt", "plate", "widget", "rod", "ring", "anvil", "gear", "gizmo"]
TARIFF_Q = f"""tq AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN 'which documents for HSN 00' || (1010 + c_custkey)
 WHEN 1 THEN 'I sell ' || {pick(_ADJ, 'c_custkey // 8 % 8')} || ' ' || {pick(_NOUN, 'c_custkey // 64 % 8')} || ', what HSN code and whether BIS certification is required?'
 WHEN 2 THEN 'tariff heading ' || (90000000 + c_custkey) || ' for ' || {pick(_NOUN, 'c_custkey // 8 % 8')}
 ELSE 'import of ' || {pick(_ADJ, 'c_custkey // 8 % 8')} || ' goods' END AS text FROM customer)"""
_TRIG = r"(?i)\bhsn\b|\bhs\s*code\b|\btariff\s*(?:code|heading|item)\b"
_WRAP = r"(?i)\b(?:" + "|".join(lx.TARIFF_WRAPPER_WORDS) + r")\b"
_CLEANQ = f"regexp_replace(regexp_replace(text, {lit(_TRIG)}, ' ', 'g'), {lit(_WRAP)}, ' ', 'g')"
_CODEKEY = r"regexp_replace(regexp_replace(text, '\D', '', 'g'), '^0+(.)', '\1')"
ORACLES["tariff_mentions"] = f"WITH {TARIFF_Q} SELECT query_id, regexp_matches(text, {lit(_TRIG)}) AS mentions FROM tq"
ORACLES["tariff_code_extract"] = rf"WITH {TARIFF_Q} SELECT query_id, nullif(regexp_extract(text, '\b\d{{2,8}}\b'), '') AS code FROM tq"
ORACLES["tariff_query_clean"] = f"WITH {TARIFF_Q} SELECT query_id, {_CLEANQ} AS cleaned FROM tq"
_BYCODE = f"coded AS (SELECT query_id, t.* FROM (SELECT query_id, {_CODEKEY} AS k FROM tq WHERE regexp_matches(text, '[0-9]')) JOIN tariff t ON t.hsn_cd = k)"
ORACLES["tariff_by_code"] = f"WITH {TARIFF_CELLS}, {TARIFF_Q}, {_BYCODE} SELECT query_id, id, hsn_cd, product FROM coded"


def _product(source: str) -> str:
    return f"""tp AS (SELECT *, id AS chunk_id FROM tariff), {bm25(source, 'tp', lx.TARIFF_WEIGHTS)},
named AS (SELECT * FROM (SELECT query_id, chunk_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC,
 CASE level WHEN 'Tariff Item' THEN 0 WHEN '7-digit' THEN 0 WHEN 'Sub-heading' THEN 1 WHEN '5-digit' THEN 1 WHEN 'Heading' THEN 2 ELSE 3 END, chunk_id) AS rank
 FROM scores JOIN tp USING (chunk_id)) WHERE rank <= 5)"""


ORACLES["tariff_by_product"] = f"""WITH {TARIFF_CELLS}, {TARIFF_Q}, cq AS (SELECT query_id, {_CLEANQ} AS text FROM tq), {_product('cq')}
SELECT query_id, id, rank, round(score, 6) AS score FROM named"""
ORACLES["tariff_lookup"] = f"""WITH {TARIFF_CELLS}, {TARIFF_Q}, {_BYCODE}, rest AS (SELECT query_id, {_CLEANQ} AS text FROM tq WHERE query_id NOT IN (SELECT query_id FROM coded)), {_product('rest')},
all_found AS (SELECT query_id, id, 1 AS rank, 'code' AS matched_by FROM coded UNION ALL SELECT query_id, id, rank, 'product' FROM named)
SELECT query_id, id, rank, coalesce(matched_by, 'product') AS matched_by, id IS NOT NULL AS found FROM tq LEFT JOIN all_found USING (query_id)"""


def card(language: str) -> str:
    says, pos = lx.CARD_CAPTIONS[language], 2 if language == "hi" else 1
    nl = "chr(10)"

    def field(f):
        return f"CASE WHEN coalesce({f[0]}, '') <> '' THEN {lit('  - ' + f[pos] + ': ')} || {f[0]} || {nl} ELSE '' END"

    imports, exports = " || ".join(map(field, lx.IMPORT_FIELDS)), " || ".join(map(field, lx.EXPORT_FIELDS))
    return f"""('HSN ' || hsn_cd || ' — ' || product || {nl} || coalesce({lit(says['chapter'])} || chapter_title || {nl}, '') || {nl} || {lit(says['import'])} || {nl} || {imports}
 || {nl} || {lit(says['export'])} || {nl} || {exports} || coalesce({nl} || {lit(says['regulator'])} || primary_regulator || {nl}, '')
 || coalesce({lit(says['verify'])} || verify_against || {nl}, ''))"""


ORACLES["tariff_cards_hi"] = f"WITH {TARIFF_CELLS} SELECT id, {card('hi')} AS card FROM tariff"
ORACLES["tariff_cards"] = f"""WITH {TARIFF_CELLS}, {TARIFF_Q}, {_BYCODE}
SELECT query_id, CASE WHEN hsn_cd IS NULL THEN {lit(lx.CARD_EMPTY['en'])} ELSE {card('en')} || chr(10) || {lit(lx.CARD_NOTE['en'])} END AS answer FROM tq LEFT JOIN coded USING (query_id)"""


# --- marks and registry
MARKS = r"""marks AS (SELECT c_custkey AS mark_id, CASE c_custkey % 8 WHEN 0 THEN 'CM/L-' || (6300000000 + c_custkey) WHEN 1 THEN 'R-' || (10000000 + c_custkey)
 WHEN 2 THEN 'IS ' || (100 + c_custkey % 90000) || ':2015' WHEN 3 THEN upper(left(md5(c_custkey::VARCHAR), 6)) WHEN 4 THEN 'IS' || (1000 + c_custkey % 9000)
 WHEN 5 THEN c_name WHEN 6 THEN ' cml' || (123456 + c_custkey) || ' ' ELSE '  ' || c_mktsegment || ' ' END AS value FROM customer),
kinded AS (SELECT mark_id, value, trim(value) AS v, CASE WHEN regexp_matches(trim(value), '(?i)^CM\s*/?\s*L\s*[-–/]?\s*\d{6,12}$') THEN 'licence'
 WHEN regexp_matches(trim(value), '(?i)^R\s*[-–]\s*\d{6,12}$') THEN 'crs'
 WHEN regexp_matches(trim(value), '(?i)^IS\s*(?:/\s*(?:IEC|ISO|EN))?\s*:?\s*\d{2,5}(?:\s*[-–]\s*\d{1,2})?(?:\s*\(?\s*Part\s*\d+\s*\)?)?(?:\s*[:\-]\s*(?:19|20)\d{2})?$') THEN 'standard'
 WHEN regexp_matches(trim(value), '(?i)^[A-Z0-9]{6}$') AND regexp_matches(value, '[0-9]') THEN 'hallmark' ELSE 'unknown' END AS kind FROM marks)"""
_KINDS = "kinds(kind, label, explanation, caution, verify_at, hint) AS (VALUES " + ", ".join(
    "(" + ", ".join(lit(v) for v in row) + ")" for row in lx.MARK_KINDS) + ")"
ORACLES["decode_marks"] = rf"""WITH {MARKS}, {_KINDS} SELECT mark_id, value, kind, kind <> 'unknown' AS recognised, label, explanation,
 CASE WHEN kind = 'licence' THEN 'Shape of a licence with ' || length(regexp_extract(v, '\d+')) || ' digits.' WHEN kind <> 'unknown' THEN 'Shape of a ' || lower(label) || '.' END AS format_note, caution, verify_at, coalesce(hint, v) AS search_hint,
 CASE WHEN kind = 'licence' AND length(regexp_extract(v, '\d+')) <> 10 THEN 'expected 10 digits, found ' || length(regexp_extract(v, '\d+')) ELSE '' END AS warnings
 FROM kinded JOIN kinds USING (kind)"""
ORACLES["mark_kind_counts"] = f"WITH {MARKS} SELECT kind, count(*) AS marks FROM kinded GROUP BY 1"
ORACLES["verify_licences"] = f"""WITH reg AS (SELECT upper('CM/L-' || (6300000000 + s_suppkey)) AS key, {pick(['cml', 'crs_r', 'huid'], 's_suppkey % 3')} AS type, s_name, s_acctbal > 0 AS active FROM supplier),
ask AS (SELECT c_custkey AS query_id, 'cm/l-' || (6300000000 + c_custkey) AS number, CASE WHEN c_custkey % 2 = 0 THEN {pick(['cml', 'crs_r', 'huid'], 'c_custkey % 3')} END AS type FROM customer)
SELECT query_id, number, r.key IS NOT NULL AS found, r.type AS matched_type, s_name AS holder, coalesce(active, false) AS active
FROM ask a LEFT JOIN reg r ON r.key = upper(a.number) AND (a.type IS NULL OR a.type = r.type)"""
_RULES = "rules(scheme, keyword) AS (VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in d.SCHEME_KEYWORDS) + ")"
_MATCHED = "matched AS (SELECT DISTINCT p_partkey AS product_id, scheme FROM part JOIN rules ON contains(lower(p_name), lower(keyword)))"
ORACLES["scheme_match"] = f"WITH {_RULES}, {_MATCHED} SELECT product_id, scheme FROM matched"
ORACLES["compliance_gaps"] = f"""WITH {_RULES}, {_MATCHED}, held AS (SELECT p_partkey AS product_id, {pick([n for n, _ in d.SCHEMES], 'p_partkey % 4')} AS scheme FROM part WHERE p_size % 3 <> 0)
SELECT product_id, scheme, CASE WHEN scheme IN ({', '.join(lit(n) for n, m in d.SCHEMES if m)}) THEN 'mandatory' ELSE 'voluntary' END AS gap FROM matched ANTI JOIN held USING (product_id, scheme)"""

# --- triage
_ABOUT = (r"(?i)^\s*(?:who\s+(?:are|r)\s+(?:you|u)|what\s+are\s+you|what\s+(?:can|do)\s+you\s+do|how\s+(?:can|do)\s+you\s+help|what\s+is\s+this|who\s+is\s+this|help|"
          r"introduce\s+yourself|about\s+you|your\s+name|(?:तुम|आप|तू)\s*कौन\s*(?:हो|है|हैं|हूँ|हूं)?|(?:तुम|आप|तू)\s*क्या\s*(?:कर\s*सकते|करते)\s*(?:हो|है|हैं|हूँ|हूं)?|"
          r"अपने\s*बारे\s*में\s*बताओ|तुम्हारा\s*नाम\s*क्या\s*है)\s*[?.!।]*\s*$")
INTENTS = f"""norm AS (SELECT *, regexp_replace(regexp_replace(lower(trim(text, ' ' || chr(10))), '[!?.,]+$', ''), '\\s+', ' ', 'g') AS nq FROM asked),
intents AS (SELECT *, CASE WHEN nq = '' THEN 'question' WHEN list_contains({lst(lx.GREETINGS)}, nq) OR (len(string_split(trim(nq), ' ')) <= 3 AND list_contains({lst(lx.GREETINGS)}, string_split(trim(nq), ' ')[1])) THEN 'greeting'
 WHEN list_contains({lst(lx.COURTESIES)}, nq) THEN 'courtesy' WHEN regexp_matches(nq, {lit(_ABOUT)}) THEN 'about' ELSE 'question' END AS intent FROM norm)"""
ORACLES["intent"] = f"WITH {ASKED}, {INTENTS} SELECT query_id, intent FROM intents"


def stems(x: str) -> str:
    w = f"regexp_extract_all(lower({x}), '[a-z]+')"
    forms = ("list_filter([w, CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%es' THEN left(w, length(w) - 2) END, "
             "CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) END], lambda z: z IS NOT NULL)")
    return f"list_sort(list_distinct(flatten(list_transform({w}, lambda w: {forms}))))"


ORACLES["stem_words"] = f"WITH {ASKED} SELECT query_id, {join(stems('text'))} AS words FROM asked"
_OUT = lst(lx.OUT_OF_DOMAIN_WORDS)


def scope_ctes(source: str, column: str) -> str:
    return f"""sc0 AS (SELECT *, trim({column}, ' ' || chr(10)) AS sq, lower(trim({column}, ' ' || chr(10))) AS low, {stems(column)} AS sw FROM {source}),
sc1 AS (SELECT *, list_sort(list_concat(list_filter(sw, lambda w: list_contains({_OUT}, w)), list_filter({lst(lx.OUT_OF_DOMAIN_PHRASES)}, lambda p: contains(low, p)))) AS off FROM sc0),
scoped AS (SELECT *, CASE WHEN length(sq) < 3 THEN 'nothing asked' WHEN len(list_filter({lst(lx.STRONG_IN_DOMAIN)}, lambda t: contains(low, t))) > 0
  OR regexp_matches(low, '\\bis\\s*(?:/\\s*(?:iec|iso|en))?\\s*:?\\s*\\d{{2,5}}\\b') THEN 'explicit standards reference'
  WHEN regexp_matches(sq, '[{DEV}]') THEN 'hindi question' WHEN len(off) > 0 THEN 'other subject: ' || array_to_string(off, ', ')
  WHEN len(list_filter(sw, lambda w: list_contains({lst(lx.IN_DOMAIN)}, w))) = 0 THEN 'no domain terms' ELSE 'words of the field' END AS scope_reason FROM sc1)"""


_IN = "scope_reason IN ('explicit standards reference', 'hindi question', 'words of the field')"
ORACLES["scope_gate"] = f"WITH {ASKED}, {scope_ctes('asked', 'text')} SELECT query_id, {_IN} AS in_scope, scope_reason AS reason FROM scoped"
_HI, _EN = lit(lx.LANGUAGE_NAMES["hi"]), lit(lx.LANGUAGE_NAMES["en"])
_LANG = f"CASE WHEN regexp_matches(text, '[{DEV}]') THEN {_HI} ELSE {_EN} END"
ORACLES["reply_language"] = f"WITH {ASKED} SELECT query_id, CASE WHEN regexp_matches(text, '[{DEV}]') OR query_id % 3 = 0 THEN {_HI} ELSE {_EN} END AS language FROM asked"
_FOLLOW = (r"(?i)^\s*(?:and\s+)?(?:what|how|why|who|when|where|which)?\s*(?:about|for|if|in that case)\b|^\s*(?:it|its|that|this|these|those|they|them|the same)\b"
           r"|^\s*(?:is|are|was|were|does|do|did|can|could|will|would|should|has|have|had)\s+(?:it|its|that|this|these|those|they|them|the same)\b|\b(?:also|instead|too|as well)\s*\??\s*$")


def follows(x: str) -> str:
    s = f"trim({x}, ' ' || chr(10))"
    return f"(len(list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> '')) <= 4 OR regexp_matches({s}, {lit(_FOLLOW)}))"


ORACLES["needs_context"] = f"WITH {ASKED} SELECT query_id, {follows('text')} AS needs FROM asked"
EXPANDED = f"""prev AS (SELECT *, last_value(CASE WHEN role = 'user' AND text <> '' THEN left({squeeze('text')}, 200) END IGNORE NULLS)
 OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_q FROM turns),
expanded AS (SELECT conv_id, turn, text, CASE WHEN last_q IS NOT NULL AND {follows('text')} THEN last_q || ' ' || trim(text, ' ' || chr(10)) ELSE text END AS expanded FROM prev WHERE role = 'user')"""
ORACLES["expand_followups"] = f"WITH {TURNS}, {EXPANDED} SELECT conv_id, turn, expanded FROM expanded"
ORACLES["history_block"] = f"""WITH {TURNS}, said AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || left({squeeze('text')}, 400) AS says,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {squeeze('text')} <> '' AS shown FROM turns WHERE text <> ''),
pairs AS (SELECT t.conv_id, t.turn, s.says, s.turn AS st, s.shown, row_number() OVER (PARTITION BY t.conv_id, t.turn ORDER BY s.turn DESC) AS back
 FROM turns t LEFT JOIN said s ON s.conv_id = t.conv_id AND s.turn < t.turn)
SELECT conv_id, turn, coalesce({lit(lx.HISTORY_HEADER)} || chr(10) || string_agg(says, chr(10) ORDER BY st) FILTER (back <= 6 AND shown) || chr(10) || chr(10), '') AS history FROM pairs GROUP BY 1, 2"""
_REPLIES = "replies(kind, code, reply) AS (VALUES " + ", ".join(f"({lit(k)}, {lit(c)}, {lit(t)})" for (k, c), t in lx.REPLIES.items()) + ")"
ORACLES["fixed_replies"] = f"""WITH {ASKED}, {INTENTS}, {_REPLIES} SELECT query_id, intent AS kind, reply FROM intents i
 LEFT JOIN replies r ON r.kind = i.intent AND r.code = CASE WHEN regexp_matches(text, '[{DEV}]') THEN 'hi' ELSE 'en' END"""
_LICID = (r"regexp_matches(text, '(?i)\bCM\s*/?\s*L\s*[-–/]?\s*\d{6,12}\b') OR regexp_matches(text, '(?i)\bR\s*[-–]\s*\d{6,12}\b') OR "
          r"len(list_filter(regexp_extract_all(text, '\b[A-Z0-9]{6}\b'), lambda h: regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Z]'))) > 0")


def seven(x: str) -> str:
    def any_of(words):
        return f"len(list_filter({lst(words)}, lambda k: contains(lower({x}), k))) > 0"
    return f"""CASE WHEN {_LICID} THEN 'verification' WHEN {any_of(SAFETY_WORDS)} THEN 'consumer_safety' WHEN {any_of(VERIFY_WORDS)} THEN 'verification'
 WHEN regexp_matches({x}, {lit(STANDARD)}) OR regexp_matches(lower({x}), '\\bclause\\s+\\d') THEN 'standard_lookup' WHEN {any_of(PROCESS_WORDS)} THEN 'process_howto'
 WHEN {any_of(SCHEME_WORDS)} THEN 'scheme_eligibility' WHEN {any_of(PRODUCT_WORDS)} THEN 'product_to_standard' ELSE 'out_of_scope' END"""


ORACLES["intent7"] = f"""WITH {ASKED}, {MARKS}, q7 AS (SELECT query_id, text FROM asked UNION ALL SELECT mark_id + 20000000000, 'what does ' || upper(value) || ' mean' FROM marks)
SELECT query_id, {seven('text')} AS intent FROM q7"""

# --- answers
ANSWERS = f"""k AS (SELECT conv_id * 16 + turn AS query_id, (conv_id * 16 + turn) % 4 AS k4, (conv_id * 16 + turn) % 5 AS k5, (conv_id * 16 + turn) % 9 AS k9, text FROM conversations WHERE role = 'assistant'),
supplied AS (SELECT query_id, k5 AS n_sources, {pick(d.LEAK_OPENERS, 'k5')} || text || CASE k4 WHEN 0 THEN ' [S' || k9 || '] and [S2]  ok [S2].' WHEN 1 THEN ' [S0' || (90 + k9) || '] see  [S12].' WHEN 2 THEN ' [S1].' ELSE '' END AS answer FROM k),
nums AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), lambda x: x::BIGINT))) AS nums FROM supplied),
checked AS (SELECT query_id, answer, list_filter(nums, lambda n: n BETWEEN 1 AND n_sources) AS cited, list_filter(nums, lambda n: n < 1 OR n > n_sources) AS invalid,
 trim(regexp_replace(regexp_replace(regexp_replace(answer, CASE WHEN len(list_filter(nums, lambda n: n < 1 OR n > n_sources)) = 0 THEN '(zz|zz)(q|q)zz' ELSE
 '\\[S(' || array_to_string(list_filter(nums, lambda n: n < 1 OR n > n_sources), '|') || ')\\]' END, '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), 'x^', ''), ' ' || chr(10)) AS text,
 trim(regexp_replace(regexp_replace(answer, '\\[S\\d+\\]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' ' || chr(10)) AS bare FROM nums)"""
ORACLES["citation_check"] = f"WITH {ANSWERS} SELECT query_id, text, {join('cited')} AS cited, {join('invalid')} AS invalid FROM checked"
ORACLES["grounding_check"] = f"""WITH {ANSWERS} SELECT query_id, CASE WHEN len(cited) > 0 THEN text ELSE bare END AS answer, {join('cited')} AS cited, {join('invalid')} AS invalid,
 len(cited) > 0 AS grounded, len(cited) = 0 AS general_knowledge FROM checked"""
ORACLES["strip_markers"] = f"WITH {ANSWERS} SELECT query_id, bare AS answer FROM checked"
_LEAK = (r"(?i)^\s*(?:we need to|let'?s (?:check|scan|look|see|go through)|i need to (?:check|find|look)|first,? (?:i|let|we)|"
         r"the user (?:wants|is asking|asked)|okay,? (?:so|let|i|we)|looking at (?:each|the) source)")
ORACLES["leaked_reasoning"] = f"WITH {ANSWERS} SELECT query_id, regexp_matches(left(answer, 200), {lit(_LEAK)}) AS leaked FROM supplied"


def found_in_notices(source: str) -> str:
    """CTEs from source(query_id, text) to hits over the notices."""
    return f"""{bm25(source, 'notices', lx.PASSAGE_WEIGHTS, 6)}, {ranked('scores', lx.TOP_K, 'hits')}"""


UNIQUE = "uq AS (SELECT min(query_id) AS query_id, text FROM questions WHERE role = 'user' GROUP BY text)"
FOUND = f"""WITH {NOTICES}, {QUESTIONS}, {UNIQUE}, {bm25('uq', 'notices', lx.PASSAGE_WEIGHTS, 6)}, {ranked('scores', lx.TOP_K, 'text_hits')},
users AS (SELECT query_id, text FROM questions WHERE role = 'user'),
hits AS (SELECT u.query_id, h.chunk_id, h.rank FROM users u JOIN uq ON uq.text = u.text JOIN text_hits h ON h.query_id = uq.query_id)"""
ORACLES["forced_refusals"] = FOUND + f""" SELECT query_id, CASE WHEN regexp_matches(text, '[{DEV}]') THEN {lit(lx.REPLIES[('nothing', 'hi')])} ELSE {lit(lx.REPLIES[('nothing', 'en')])} END AS answer
 FROM users ANTI JOIN hits USING (query_id)"""
ORACLES["source_block"] = FOUND + """ SELECT query_id, string_agg('[S' || rank || '] ' || title || chr(10) || '(file: ' || relpath || ', page ' || page_number
 || coalesce(', downloaded from ' || source_url, '') || ')' || chr(10) || trim(left(text, 1400)), chr(10) || chr(10) ORDER BY rank) AS sources FROM hits JOIN notices USING (chunk_id) GROUP BY 1"""


def extract(source: str, hits: str, passages: str = "notices") -> str:
    """CTEs ending in quoted(query_id, ranks, lines)."""
    return f"""terms AS (SELECT query_id, list_distinct(list_filter(list_transform(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2), lambda t: lower(t)),
  lambda t: NOT list_contains({lst(lx.ANSWER_STOPWORDS)}, t))) AS terms FROM {source}),
sents0 AS (SELECT h.query_id, h.rank, n.relpath, n.page_number, terms, string_split(regexp_replace(n.text, '([.;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss
  FROM {hits} h JOIN {passages} n USING (chunk_id) JOIN terms t ON t.query_id = h.query_id WHERE h.rank <= 5),
sents AS (SELECT query_id, rank, relpath, page_number, terms, unnest(ss) AS s, unnest(range(0, len(ss))) AS pos FROM sents0),
counted AS (SELECT *, len(list_filter(terms, lambda t: contains(lower(s), t))) AS c FROM sents),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY c DESC, pos) AS bn FROM counted WHERE c > 0),
lined AS (SELECT query_id, rank, '[S' || rank || '] ' || relpath || ', page ' || page_number || ':' || chr(10) || '    ' || string_agg(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), chr(10) || '    ' ORDER BY bn) AS line
  FROM best WHERE bn <= 2 GROUP BY query_id, rank, relpath, page_number),
quoted AS (SELECT query_id, string_agg(rank::VARCHAR, ' | ' ORDER BY rank) AS cited, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS lines, list(rank) AS ranks FROM lined GROUP BY 1)"""


def _say(kind: str) -> str:
    return f"CASE WHEN regexp_matches(text, '[{DEV}]') THEN {lit(lx.REPLIES[(kind, 'hi')])} ELSE {lit(lx.REPLIES[(kind, 'en')])} END"


ORACLES["extractive_answers"] = FOUND + f""", {extract('users', 'hits')} SELECT query_id, CASE WHEN q.lines IS NULL THEN {_say('nothing')} ELSE {_say('quoted')} || chr(10) || chr(10) || q.lines END AS answer,
 coalesce(cited, '') AS cited, q.lines IS NOT NULL AS grounded, q.lines IS NULL AS refused, q.lines IS NOT NULL AS extractive,
 CASE WHEN q.lines IS NULL THEN 'no sentence of the hits has a term of the question' ELSE '' END AS reason FROM users LEFT JOIN quoted q USING (query_id)"""
ORACLES["cited_sources"] = FOUND + f""", {extract('users', 'hits')} SELECT h.query_id, h.rank, h.chunk_id, q.ranks IS NOT NULL AS is_cited FROM hits h LEFT JOIN quoted q USING (query_id)
 WHERE q.ranks IS NULL OR list_contains(q.ranks, h.rank)"""
ORACLES["answer_batch"] = f"""WITH {NOTICES}, {QUESTIONS}, turns AS (SELECT conv_id, turn, role, text FROM questions), {EXPANDED},
asked AS (SELECT conv_id * 8 + turn AS query_id, text, expanded FROM expanded), {INTENTS}, {scope_ctes('intents', 'expanded')},
judged AS (SELECT query_id, text, expanded, intent, {_IN} AS in_scope, scope_reason FROM scoped),
surv AS (SELECT * FROM judged WHERE intent = 'question' AND in_scope), uq AS (SELECT min(query_id) AS query_id, expanded AS text FROM surv GROUP BY expanded),
{found_in_notices('uq')}, allhits AS (SELECT s.query_id, h.rank, h.chunk_id, h.score FROM surv s JOIN uq ON uq.text = s.expanded JOIN hits h ON h.query_id = uq.query_id),
{extract('surv', 'allhits')}, {_REPLIES}, firsts AS (SELECT query_id, min_by(score, rank) AS fs FROM allhits GROUP BY 1)
SELECT query_id, 'answer' AS kind, CASE WHEN q.lines IS NULL THEN {_say('nothing')} ELSE {_say('quoted')} || chr(10) || chr(10) || q.lines END AS answer, coalesce(cited, '') AS cited,
 q.lines IS NOT NULL AS grounded, q.lines IS NULL AS refused, q.lines IS NOT NULL AS extractive,
 CASE WHEN q.lines IS NULL THEN 'no sentence of the hits has a term of the question' WHEN fs IS NULL THEN 'no matching passage' WHEN round(fs, 9) >= 2.0 THEN '' ELSE 'below the keyword floor' END AS reason
 FROM surv LEFT JOIN quoted q USING (query_id) LEFT JOIN firsts USING (query_id)
UNION ALL SELECT query_id, CASE WHEN intent = 'question' THEN 'refusal' ELSE 'small_talk' END, reply, '', false, intent = 'question', false,
 CASE WHEN intent = 'question' THEN 'out of scope: ' || scope_reason ELSE 'small talk: ' || intent END
 FROM judged j LEFT JOIN replies r ON r.kind = CASE WHEN intent = 'question' THEN 'refusal' ELSE intent END AND r.code = CASE WHEN regexp_matches(text, '[{DEV}]') THEN 'hi' ELSE 'en' END
 WHERE intent <> 'question' OR NOT in_scope"""
_W = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"


def _shingles(table: str, key: str) -> str:
    return f"(SELECT {key}, unnest(list_transform(range(1, len(w) - 24), lambda i: array_to_string(w[i:i + 25], ' '))) AS sh, unnest(range(0, len(w) - 25)) AS pos FROM (SELECT {key}, {_W} AS w FROM {table}) WHERE len(w) >= 26)"


RUNS = f"""m AS (SELECT a.doc_id, b.item_id, a.pos AS l, b.pos AS r FROM {_shingles('documents', 'doc_id')} a JOIN {_shingles('benchmark', 'item_id')} b USING (sh)),
isl AS (SELECT *, l - row_number() OVER (PARTITION BY doc_id, item_id, l - r ORDER BY l) AS island FROM m),
runs AS (SELECT doc_id, item_id, min(l) AS left_start, min(r) AS right_start, count(*) + 25 AS n_words FROM isl GROUP BY doc_id, item_id, l - r, island)"""
ORACLES["verbatim_runs"] = f"WITH {RUNS} SELECT doc_id, item_id, left_start, right_start, n_words FROM runs"

# --- routing
_IND = ["gold", "electronics", "electrical", "chemicals", "steel", "textiles", "footwear", "glass", "other", "Gold", "toys"]
CASES = f"""cases AS (SELECT c_custkey AS case_id, lower(coalesce(CASE WHEN c_custkey % 13 <> 0 THEN {pick(['industrial', 'consumer', 'INDUSTRIAL'], 'c_custkey % 3')} END, '')) AS sector,
 lower({pick(_IND, f'c_custkey % {len(_IND)}')}) AS industry, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN {pick(['india', 'abroad'], 'c_custkey // 3 % 2')} END, '') AS location,
 {pick(['domestic', 'import', 'export'], 'c_custkey // 6 % 3')} AS trade, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN {pick(['required', 'verify', 'complaint'], 'c_custkey // 3 % 3')} END, '') AS need FROM customer),
qs AS (""" + " UNION ALL ".join(
    f"SELECT case_id, {lit(key)} AS key, {pos} AS position, {key} AS given, {key} IN ({', '.join(lit(v) for v in allowed)}) AS allowed FROM cases"
    + (f" WHERE {gov[0]} = {lit(gov[1])}" if gov else "") for key, pos, allowed, gov in lx.QUESTIONS) + ")"
ORACLES["visible_questions"] = f"WITH {CASES} SELECT case_id, key, position::BIGINT AS position FROM qs"
VALID = """checks AS (SELECT case_id, coalesce(string_agg(key, ' | ' ORDER BY position) FILTER (given = ''), '') AS missing,
 coalesce(string_agg(key, ' | ' ORDER BY position) FILTER (given <> '' AND NOT allowed), '') AS disallowed FROM qs GROUP BY 1)"""
ORACLES["pathway_validate"] = f"WITH {CASES}, {VALID} SELECT case_id, missing, disallowed, missing = '' AND disallowed = '' AS valid FROM checks"
ORACLES["next_question"] = f"WITH {CASES} SELECT case_id, min_by(key, position) FILTER (given = '') AS next_key FROM qs GROUP BY 1"
ROUTED = f"""routed AS (SELECT case_id, sector, CASE WHEN sector = 'consumer' THEN 'CONSUMER-' || upper(need) WHEN trade = 'export' THEN 'EXPORT' WHEN industry = 'electronics' THEN 'CRS' WHEN industry = 'gold' THEN 'HALLMARK'
 WHEN trade = 'import' OR location = 'abroad' THEN 'FMCS' ELSE 'ISI' END AS scheme_code, CASE WHEN sector = 'consumer' THEN need WHEN trade = 'export' THEN 'export' WHEN industry = 'electronics' THEN 'crs' WHEN industry = 'gold' THEN 'hallmark'
 WHEN trade = 'import' THEN 'import' WHEN location = 'abroad' THEN 'fmcs' ELSE 'isi' END AS step_list FROM cases JOIN checks USING (case_id) WHERE missing = '' AND disallowed = '')"""
_NAMES = "names(scheme_code, scheme) AS (VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in lx.SCHEME_NAMES.items()) + ")"
ORACLES["pathway_route"] = f"""WITH {CASES}, {VALID}, {ROUTED}, {_NAMES} SELECT case_id, sector, scheme_code, scheme, step_list,
 CASE WHEN scheme_code = 'EXPORT' THEN {lit(lx.EXPORT_CAVEAT)} ELSE {lit(lx.ROUTE_CAVEAT)} END AS caveat FROM routed JOIN names USING (scheme_code)"""
_STEPS = "steps(step_list, position, title, text) AS (VALUES " + ", ".join(f"({lit(a)}, {b}, {lit(c)}, {lit(e)})" for a, b, c, e in lx.STEPS) + ")"
ORACLES["pathway_steps"] = f"""WITH {NOTICES}, {CASES}, {VALID}, {ROUTED}, {_STEPS}, sq AS (SELECT row_number() OVER (ORDER BY text) AS query_id, text FROM (SELECT DISTINCT text FROM steps)),
{bm25('sq', 'notices', lx.PASSAGE_WEIGHTS)}, {ranked('scores', 3, 'hits')}, cit AS (SELECT query_id, string_agg(relpath || ' p.' || page_number, '; ' ORDER BY rank) AS citations FROM hits JOIN notices USING (chunk_id) GROUP BY 1)
SELECT case_id, scheme_code, position::BIGINT AS position, title, CASE WHEN citations IS NULL THEN {lit(lx.STEP_NOT_COVERED)} ELSE {lit(lx.STEP_COVERED)} END AS detail, coalesce(citations, '') AS citations
FROM routed JOIN steps USING (step_list) JOIN sq USING (text) LEFT JOIN cit USING (query_id)"""

_VECTOR = f"""(SELECT list_transform(c, lambda x: (CASE WHEN norm > 0 THEN x / norm ELSE 0 END)::FLOAT::DOUBLE) FROM (SELECT c, sqrt(list_dot_product(c, c)) AS norm FROM (
 SELECT list_transform(range(0, 64), lambda i: len(list_filter(slots, lambda x: x = i))::DOUBLE) AS c)))"""


def vectors_of(name: str, source: str, key: str) -> str:
    """CTE of hashed vectors: ``name`` (key, e)."""
    return f"""{name} AS (SELECT {key}, {_VECTOR} AS e FROM (SELECT {key}, list_transform({tokens('text')}, lambda t: ('0x' || left(md5(t), 7))::INT % 64) AS slots FROM {source}))"""


ORACLES["document_answers"] = f"""WITH {PASSAGES}, said AS (SELECT text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
given AS (SELECT text FROM said UNION SELECT {lit(d.TURN_OPENER)} || text FROM said UNION SELECT {lit(d.ITEM_OPENER)} || text FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT ('0x' || left(md5(text), 12))::BIGINT AS query_id, text, text AS expanded FROM given), {INTENTS}, {scope_ctes('intents', 'expanded')},
judged AS (SELECT query_id, text, expanded, intent, {_IN} AS in_scope, scope_reason FROM scoped),
surv AS (SELECT * FROM judged WHERE intent = 'question' AND in_scope), {bm25('surv', 'passages', lx.PASSAGE_WEIGHTS, 3)}, {ranked('scores', lx.CANDIDATE_K, 'kw')},
{vectors_of('qv', 'surv', 'query_id')}, {vectors_of('pv', 'passages', 'chunk_id')},
dense AS (SELECT query_id, chunk_id, list_dot_product(qv.e, pv.e) AS score FROM qv, pv), {ranked('dense', lx.CANDIDATE_K, 'sem')},
fused AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + kw.rank), 0) + coalesce(1.0::DOUBLE / (60 + sem.rank), 0) AS score,
  kw.rank AS keyword_rank, sem.rank AS semantic_rank, sem.score AS semantic_score FROM kw FULL JOIN sem USING (query_id, chunk_id)),
{ranked('fused', lx.TOP_K, 'hybrid', 'keyword_rank NULLS LAST, semantic_rank NULLS LAST, ')},
{extract('surv', 'hybrid', 'passages')}, {_REPLIES}, firsts AS (SELECT query_id, min_by(score, rank) AS fs, max(semantic_score) AS cosine FROM hybrid GROUP BY 1)
SELECT query_id, 'answer' AS kind, CASE WHEN q.lines IS NULL THEN {_say('nothing')} ELSE {_say('quoted')} || chr(10) || chr(10) || q.lines END AS answer, coalesce(cited, '') AS cited,
 q.lines IS NOT NULL AS grounded, q.lines IS NULL AS refused, q.lines IS NOT NULL AS extractive,
 CASE WHEN q.lines IS NULL THEN 'no sentence of the hits has a term of the question' WHEN fs IS NULL THEN 'no matching passage'
  WHEN cosine IS NOT NULL THEN CASE WHEN round(cosine, 9) >= {lx.MIN_COSINE} THEN '' ELSE 'below the cosine floor' END
  WHEN round(fs, 9) >= {lx.MIN_KEYWORD_SCORE} THEN '' ELSE 'below the keyword floor' END AS reason
 FROM surv LEFT JOIN quoted q USING (query_id) LEFT JOIN firsts USING (query_id)
UNION ALL SELECT query_id, CASE WHEN intent = 'question' THEN 'refusal' ELSE 'small_talk' END, reply, '', false, intent = 'question', false,
 CASE WHEN intent = 'question' THEN 'out of scope: ' || scope_reason ELSE 'small talk: ' || intent END
 FROM judged j LEFT JOIN replies r ON r.kind = CASE WHEN intent = 'question' THEN 'refusal' ELSE intent END AND r.code = CASE WHEN regexp_matches(text, '[{DEV}]') THEN 'hi' ELSE 'en' END
 WHERE intent <> 'question' OR NOT in_scope"""
ORACLES["routed_topk"] = f"""WITH {NOTICES}, asked AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 3 <> 0 THEN ' See IS ' || (300 + item_id % 60) ELSE '' END
 || CASE WHEN item_id % 3 = 1 THEN ', clause ' || (item_id % 9 + 1) || '.' || (item_id % 4 + 1) ELSE '' END || ' about a licence' AS text FROM benchmark), {found_in_notices('asked')},
idx AS (SELECT DISTINCT unnest(list_concat(standard_ids, gazette_ids)) AS identifier, chunk_id, page_number, regexp_extract_all(text, '(?i)\\bclause\\s+(\\d+(?:\\.\\d+)*)', 1) AS clauses FROM notices),
wanted AS (SELECT query_id, unnest(list_concat({standards('text')}, {gazettes('text')})) AS identifier, regexp_extract_all(text, '(?i)\\bclause\\s+(\\d+(?:\\.\\d+)*)', 1) AS asked_clauses FROM asked),
staged AS (SELECT query_id, chunk_id, CASE WHEN list_has_any(clauses, asked_clauses) THEN 0 ELSE 1 END AS stage, page_number AS place FROM wanted JOIN idx USING (identifier)
 UNION ALL SELECT query_id, chunk_id, 2, rank FROM hits),
firsts AS (SELECT query_id, chunk_id, min({{'stage': stage, 'place': place}}) AS f FROM staged GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f.stage, f.place, chunk_id) AS rank FROM firsts)
SELECT query_id, rank, chunk_id, CASE f.stage WHEN 0 THEN 'clause' WHEN 1 THEN 'identifier' ELSE 'search' END AS route FROM numbered WHERE rank <= {lx.TOP_K}"""
ORACLES["pathway_evidence"] = f"""WITH {NOTICES}, {_STEPS}, sq AS (SELECT row_number() OVER (ORDER BY text) AS query_id, text FROM (SELECT DISTINCT text FROM steps)),
{bm25('sq', 'notices', lx.PASSAGE_WEIGHTS)}, {ranked('scores', lx.CANDIDATE_K, 'kw')}, {vectors_of('qv', 'sq', 'query_id')}, {vectors_of('pv', 'notices', 'chunk_id')},
dense AS (SELECT query_id, chunk_id, list_dot_product(qv.e, pv.e) AS score FROM qv, pv), {ranked('dense', lx.CANDIDATE_K, 'sem')},
fused AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + kw.rank), 0) + coalesce(1.0::DOUBLE / (60 + sem.rank), 0) AS score,
  kw.rank AS keyword_rank, sem.rank AS semantic_rank FROM kw FULL JOIN sem USING (query_id, chunk_id)),
{ranked('fused', 3, 'hybrid', 'keyword_rank NULLS LAST, semantic_rank NULLS LAST, ')}
SELECT step_list, position::BIGINT AS position, title, CASE WHEN rank IS NULL THEN {lit(lx.STEP_NOT_COVERED)} ELSE {lit(lx.STEP_COVERED)} END AS detail,
 rank, relpath, page_number, left(n.text, {lx.STEP_PASSAGE_CHARS}) AS passage
FROM (SELECT step_list, position, steps.title, query_id FROM steps JOIN sq USING (text)) LEFT JOIN hybrid USING (query_id) LEFT JOIN (SELECT chunk_id, relpath, page_number, text FROM notices) n USING (chunk_id)"""

# --- reports
ORACLES["category_stats"] = """WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT n_name AS category, count(*) AS documents, sum(c_custkey % 11 + 1)::BIGINT AS pages, sum(c_custkey % 3)::BIGINT AS scanned, sum(c_custkey % 4)::BIGINT AS corrupt, coalesce(sum(n), 0)::BIGINT AS chunks
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN per ON o_custkey = c_custkey GROUP BY 1"""
ORACLES["corpus_totals"] = """SELECT count(*) AS documents, sum(c_custkey % 11 + 3)::BIGINT AS pages, sum(c_custkey % 11 + 3 - c_custkey % 3 - c_custkey % 2)::BIGINT AS pages_ok, sum(c_custkey % 3)::BIGINT AS pages_scanned,
 sum(c_custkey % 2)::BIGINT AS pages_corrupt, count(*) FILTER (c_custkey % 19 = 0) AS failed_documents, (SELECT count(*) - count(DISTINCT text) FROM documents) AS duplicate_files_skipped,
 (SELECT count(*) FROM orders) AS chunks, round(100.0::DOUBLE * sum(c_custkey % 11 + 3 - c_custkey % 3 - c_custkey % 2) / sum(c_custkey % 11 + 3), 6) AS usable_page_pct FROM customer"""
ORACLES["index_health"] = """SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM embeddings) > 0 AS semantic_available"""
_SCAN = "r AS (SELECT 'suppliers/' || s_name || '.txt' AS relpath, s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS pages_scanned FROM supplier)"
ORACLES["top_scanned"] = f"WITH {_SCAN} SELECT relpath, pages_scanned FROM r WHERE pages_scanned > 0 ORDER BY pages_scanned DESC, relpath LIMIT 10"
ORACLES["unreadable_docs"] = f"WITH {_SCAN} SELECT relpath, 'ValueError: damaged' AS error FROM r WHERE s_suppkey % 7 = 0"
ORACLES["recall_at_k"] = f"""WITH {NOTICES}, nq AS (SELECT n_nationkey::BIGINT AS query_id, 'what about IS ' || (300 + n_nationkey) || ' and the licence fee' AS text FROM nation), {found_in_notices('nq')},
good AS (SELECT query_id, min(rank) AS rank FROM hits JOIN notices USING (chunk_id) WHERE rank <= 5 AND list_contains(standard_ids, 'IS ' || (300 + query_id)) GROUP BY 1)
SELECT count(*) AS cases, round(avg((rank IS NOT NULL)::INT), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM nq LEFT JOIN good USING (query_id)"""
_EXP = ["standard_lookup", "out_of_scope", "out_of_scope", "out_of_scope", "out_of_scope", "out_of_scope", "process_howto"]
ORACLES["answer_metrics"] = f"""WITH {QUESTIONS}, p AS (SELECT query_id AS k, {seven('text')} AS intent, {pick(_EXP, f'query_id % {len(_EXP)}')} AS expected FROM questions)
SELECT count(*) AS questions, round(avg((intent = expected)::INT), 6) AS intent_accuracy, round(count(*) FILTER (k % 2 = 0 AND k % 3 > 0 AND k % 5 <> 0) / count(*) FILTER (k % 2 = 0), 6) AS citation_precision,
 round(count(*) FILTER (k % 6 = 0 AND k % 4 = 0) / count(*) FILTER (k % 6 = 0), 6) AS forced_refusal_accuracy, round(count(*) FILTER (k % 6 <> 0 AND k % 4 = 0) / count(*) FILTER (k % 6 <> 0), 6) AS false_refusal_rate,
 round(avg(k % 101), 6) AS mean_latency_ms FROM p"""
MSG = "msg AS (SELECT conv_id, role, conv_id * 16 + turn AS k FROM conversations)"
ORACLES["conversation_analytics"] = f"""WITH {MSG} SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages, coalesce(sum(k % 3) FILTER (role = 'assistant'), 0)::BIGINT AS guardrail_violations,
 round(count(*) FILTER (role = 'assistant' AND k % 5 = 0) / count(*) FILTER (role = 'assistant'), 6) AS forced_refusal_rate, round(avg(k % 97) FILTER (role = 'assistant'), 6) AS mean_latency_ms,
 count(*) FILTER (role = 'assistant' AND k % 4 = 0) AS feedback_up, count(*) FILTER (role = 'assistant' AND k % 4 = 1) AS feedback_down,
 round(count(*) FILTER (role = 'assistant' AND k % 4 < 2) / count(*) FILTER (role = 'assistant'), 6) AS feedback_response_rate FROM msg"""
ORACLES["intent_distribution"] = f"""WITH {MSG} SELECT {pick(['standard_lookup', 'process_howto', 'verification', 'out_of_scope'], 'k % 4')} AS intent, count(*) AS messages FROM msg WHERE role = 'assistant' GROUP BY 1"""
CALLS = """calls AS (SELECT ts, event_id AS id, (props->>'$.k')::BIGINT - 20 AS p, floor(value)::BIGINT - 5 AS c FROM events)"""
ORACLES["daily_usage"] = f"""WITH {CALLS} SELECT ts::DATE AS date, count(*) AS calls, sum(greatest(p, 0))::BIGINT AS prompt_tokens, sum(greatest(c, 0))::BIGINT AS completion_tokens,
 (sum(greatest(p, 0)) + sum(greatest(c, 0)))::BIGINT AS total_tokens FROM calls GROUP BY 1"""
ORACLES["stream_daily_usage"] = ORACLES["daily_usage"]
ORACLES["cap_admission"] = f"WITH {CALLS} SELECT ts::DATE AS date, id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, id) <= {CAP} AS admitted FROM calls"
ORACLES["stream_cap"] = ORACLES["cap_admission"]
ORACLES["cap_remaining"] = f"""WITH {CALLS} SELECT ts::DATE AS date, least(count(*), {CAP}) AS admitted_calls, greatest({CAP} - count(*), 0) AS remaining FROM calls GROUP BY 1"""
ORACLES["latest_feedback"] = "SELECT user_id AS message_id, max_by(event_id * 7 % 3 - 1, (ts, event_id)) AS rating FROM events GROUP BY 1"
ORACLES["page_titles"] = r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, '' AS identifiers FROM pages"""
ORACLES["stream_embed"] = "SELECT doc_id AS chunk_id, 64::BIGINT AS dim FROM documents"
ORACLES["hits_json"] = HYBRID + " SELECT query_id, " + _POSITION + """, '{"chunk_id":' || chunk_id || ',"title":' || to_json(title) || ',"category":' || to_json(category) || ',"relpath":' || to_json(relpath)
 || ',"page_number":' || page_number || ',"citation":' || to_json(relpath || ' p.' || page_number) || ',"score":' || round(score, 6)
 || ',"matched_by":[' || CASE WHEN keyword_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN '"keyword","semantic"' WHEN keyword_rank IS NOT NULL THEN '"keyword"' WHEN semantic_rank IS NOT NULL THEN '"semantic"' ELSE '' END || ']'
 || coalesce(',"keyword_rank":' || keyword_rank, '') || coalesce(',"semantic_rank":' || semantic_rank, '') || ',"text":' || to_json(text) || '}' AS hit FROM hybrid JOIN passages USING (chunk_id)"""
