"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from functools import reduce

from sextant.functions import text as T
from sextant.functions.classify import RULES, STRUCTURAL
from sextant.functions.tokens import FILLERS, STOP_WORDS
from sextant.queries import NOISE_CHARS, NOISE_LINES, QUESTIONS
from sextant.sources.files import EXTENSIONS, HTML, MARKDOWN


def q(s: str) -> str:
    """A SQL string of any characters."""
    parts, plain = [], ""
    for c in s:
        if 32 <= ord(c) < 127:
            plain += c.replace("'", "''")
        else:
            parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
    parts += [f"'{plain}'"] * (bool(plain) or not parts)
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def rep(x: str, pattern: str, to: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to}, '{flags}')"


def strip(x: str) -> str:
    return rep(x, r"^\s+|\s+$")


def picked(options, key: str) -> str:
    return f"([{', '.join(map(q, options))}])[CAST({key} % {len(options)} + 1 AS INT)]"


def html(x: str) -> str:
    x = rep(rep(rep(rep(x, r"<!--.*?-->", "''", "gs"), r"<script[^>]*>.*?</script>", "''", "gis"), r"<style[^>]*>.*?</style>", "''", "gis"), r"<[^>]+>", "' '")
    return reduce(lambda a, e: f"replace({a}, {q(e[0])}, {q(e[1])})", T.ENTITIES, x)


def unicode_(x: str) -> str:
    x = reduce(lambda a, r: f"replace({a}, {q(r[0])}, {q(r[1])})", T.STAND_INS, f"nfc_normalize({x})")
    return rep(x, r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]")


def boilerplate(x: str) -> str:
    x = reduce(lambda a, p: rep(a, f"(?im){p}"), T.BOILERPLATE, x)
    x = rep(rep(x, f"(?m){T.NUMBER_LINE}"), f"(?m){T.MARK_LINE}")
    return strip(rep(x, r"\n{3,}", "chr(10) || chr(10)"))


def lines_ended(x: str) -> str:
    return f"replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' ')"


def paragraphs(x: str) -> str:
    x = rep(lines_ended(x), r"\n\s*\n", "chr(10) || chr(10)")
    line = f"list_filter(list_transform(string_split({rep('p', ' +', "' '")}, chr(10)), lambda l: {strip('l')}), lambda l: l != '')"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: array_to_string({line}, ' ')), lambda p: p != ''), chr(10) || chr(10))"


def urls(x: str) -> str:
    return reduce(lambda a, p: rep(a, p), T.URLS, x)


def tokens(x: str, fillers: bool = False) -> str:
    drop = ", ".join(f"'{w}'" for w in STOP_WORDS + (FILLERS if fillers else ()))
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({drop}))"


def sentences(x: str) -> str:
    cut = f"string_split({rep(strip(x), r'([.!?])\s+', "'\\1' || chr(1)")}, chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s != '')"


def truncate(x: str, n: int) -> str:
    one = strip(rep(x, r"\s+", "' '"))
    return f"CASE WHEN length({one}) > {n} THEN {one}[1:{n - 3}] || '...' ELSE {one} END"


TURNS = """t AS (SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS answer, lag(text) OVER w AS question, lag(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user')"""
CLOSED = """c AS (SELECT doc_id, text, lang, source, length(text) AS n, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 500) / 450.0) AS BIGINT) + 1 END)) AS i FROM documents),
x AS (SELECT *, i * 450 AS a, least(i * 450 + 500, n) AS b FROM c),
z AS (SELECT *, regexp_replace(text[a + 1:b], '^\\s+|\\s+$', '', 'g') AS content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ci, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total FROM x WHERE regexp_replace(text[a + 1:b], '^\\s+|\\s+$', '', 'g') != '')"""
CID = "format('{}-chunk-{:04d}', doc_id, ci)"


def scored(threshold: float = 0.05) -> str:
    """Parts of tokens of each answer's sentences that the question has."""
    part = f"list_transform({sentences('answer')}, lambda s: CASE WHEN len(list_distinct({tokens('s')})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({tokens('s')}), list_distinct({tokens('question')}))) / len(list_distinct({tokens('s')})) END)"
    return f"{TURNS}, s AS (SELECT *, {part} AS p FROM t)"


OUTCOMES = f"""{scored()}, o AS (SELECT *, CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda v: round(v, 4) >= 0.05)) / len(p), 4) ELSE 0 END AS confidence, CAST(turn % 4 AS INT) AS cnt, CASE WHEN conv_id % 7 = 0 THEN 'no luck' END AS error FROM s)"""


def relevance(question: str = "question", answer: str = "answer") -> str:
    qs, a = f"list_distinct({tokens(question, True)})", tokens(answer, True)
    w = "list_sum(list_transform({}, lambda t: 2.0 - len(list_filter(a, lambda y: y = t)) / greatest(len(a), 1)))"
    return f"""SELECT conv_id, turn, CASE WHEN trim(answer) = '' THEN 0.0 WHEN len(qs) = 0 THEN 1.0 ELSE round(greatest(0.0, least(1.0, coalesce({w.format("list_intersect(qs, a)")}, 0.0) / {w.format("qs")} * CASE WHEN len(list_distinct(a)) < len(qs) THEN 0.5 + 0.5 * len(list_distinct(a)) / len(qs) ELSE 1.0 END)), 4) END AS relevance
  FROM (SELECT *, {qs} AS qs, {a} AS a FROM t)"""


def classified(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"CASE WHEN {s} = '' THEN 'unsupported' " + " ".join(f"WHEN regexp_matches({s}, {q('(?i)' + p)}) THEN '{n}'" for n, p in RULES) + f" WHEN {s} LIKE '%?' THEN 'factual' ELSE 'unsupported' END"


def sniffed(x: str) -> str:
    s = strip(x)
    page = " OR ".join(f"regexp_matches(lower({s}), {q(p)})" for p in HTML)
    marks = " + ".join(f"CAST(regexp_matches({s}, {q('(?m)' + p)}) AS INT)" for p in MARKDOWN)
    return f"CASE WHEN {s} = '' THEN NULL WHEN regexp_matches({s}, '^[\\[{{]') AND json_valid({s}) THEN 'json' WHEN {page} THEN 'html' WHEN {marks} >= 2 THEN 'md' ELSE 'txt' END"


def named(source: str, x: str) -> str:
    return f"coalesce(CASE lower(regexp_extract({source}, '(\\.[^./\\\\]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in EXTENSIONS.items()) + f" END, {sniffed(x)})"


def ranked(score: str, where: str = "TRUE", floor: str = "") -> str:
    return f"""WITH r AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, round(greatest(0.0, least(1.0, {score})), 12) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {where}),
n AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, round(score, 6) AS score FROM r) SELECT * FROM n WHERE rank <= 5 {floor}"""


A, B = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"
_WORDS = "unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w != ''))"
_VECTOR = """SELECT id, list_transform(range(64), lambda b: CAST(len(list_filter(p, lambda y: y = b)) AS DOUBLE)) AS c FROM (SELECT id, list(CAST('0x' || substr(md5(w), 31, 2) AS INT) % 64) AS p FROM {w} GROUP BY id)"""
_UNIT = "list_transform(c, lambda v: CAST(v / sqrt(list_sum(list_transform(c, lambda y: y * y))) AS FLOAT))"
PASSAGES = f"""dw AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
dv AS (SELECT id, CAST({_UNIT} AS DOUBLE[]) AS v FROM ({_VECTOR.format(w="dw")})), bv AS (SELECT id, CAST({_UNIT} AS DOUBLE[]) AS v FROM ({_VECTOR.format(w="bw")})),
pr AS (SELECT b.id AS question_id, CAST(d.id AS VARCHAR) AS chunk_id, round(greatest(0.0, least(1.0, list_cosine_similarity(b.v, d.v))), 12) AS score FROM bv b, dv d),
pn AS (SELECT question_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pr.score DESC, chunk_id) AS INT) AS rank FROM pr QUALIFY rank <= 5),
p AS (SELECT pn.*, d.text AS content, d.source, b.text AS question FROM pn JOIN documents d ON CAST(d.doc_id AS VARCHAR) = pn.chunk_id JOIN benchmark b ON b.item_id = pn.question_id)"""
_NAME = "source || '.txt'"
_TWO = "printf('%.2f', round(score, 4) + 1e-9)"

ORACLES: dict[str, str] = {
    "clean_html_pages": f"SELECT page_id, {html('html')} AS cleaned FROM pages",
    "clean_unicode_docs": f"SELECT doc_id, {unicode_(f"(text || ' ' || {picked(NOISE_CHARS, 'doc_id')})")} AS cleaned FROM documents",
    "clean_boilerplate_docs": f"SELECT doc_id, {boilerplate(f"(text || chr(10) || {picked(NOISE_LINES, 'doc_id')} || chr(10) || chr(10) || chr(10) || chr(10) || 'end')")} AS cleaned FROM documents",
    "normalize_ws_docs": f"""WITH x AS (SELECT doc_id, text || {q("\r\n  a  b\tc \r \n \n d\n\n\n")} || lang AS t FROM documents) SELECT doc_id, {paragraphs("t")} AS paragraphs, {strip(rep(lines_ended("t"), r"\s+", "' '"))} AS flat FROM x""",
    "strip_urls_emails": f"SELECT doc_id, {rep(urls("(text || ' https://a.example/x?y=1 www.b.example/z, mail ' || source || '@c.example now')"), T.EMAIL)} AS cleaned FROM documents",
    "clean_full": f"WITH x AS (SELECT page_id, {rep(urls(unicode_(html('html'))), T.EMAIL)} AS t FROM pages), y AS (SELECT page_id, {boilerplate('t')} AS t FROM x) SELECT page_id, lower({paragraphs('t')}) AS cleaned FROM y",
    "doc_ids": f"SELECT page_id, 'doc-' || sha256(lower({strip("('  ' || upper(url) || chr(10))")})) AS document_id FROM pages",
    "detect_type": f"""WITH x AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN {q("# Title\n\n* item **bold**\n")} || text WHEN 1 THEN CAST(json_object('text', text) AS VARCHAR) ELSE text END AS t FROM documents)
SELECT 'd' || doc_id AS key, {sniffed("t")} AS kind, {named("(source || '.md')", "text")} AS named FROM x UNION ALL SELECT 'p' || page_id, {sniffed("html")}, {named("url", "html")} FROM pages""",
    "front_matter": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Ann ' || source WHEN 1 THEN 'Bob ' || lang END AS author, CASE doc_id % 3 WHEN 0 THEN 'one,two,' || lang ELSE '' END AS tags FROM documents""",
    "page_numbers": f"""WITH x AS (SELECT doc_id, source, CASE WHEN doc_id % 4 IN (0, 1, 3) THEN CAST(doc_id AS INT) END AS chapter, CASE WHEN doc_id * 7 BETWEEN 1 AND 9999 THEN CAST(doc_id * 7 AS INT) END AS page FROM documents)
SELECT doc_id, chapter, page, CASE WHEN chapter IS NOT NULL AND page IS NOT NULL THEN 'Chapter ' || chapter || ', p. ' || page WHEN page IS NOT NULL THEN 'p. ' || page ELSE source END AS label, CASE WHEN doc_id BETWEEN 1 AND 9999 THEN CAST(doc_id AS INT) END AS labelled FROM x""",
    "chunk_fixed_closed": f"WITH {CLOSED} SELECT {CID} AS id, CAST(doc_id AS VARCHAR) AS document_id, content, CAST(a AS INT) AS start_idx, CAST(b AS INT) AS end_idx, ci AS chunk_index, total AS total_chunks, CASE WHEN ci > 0 THEN 50 ELSE 0 END AS overlap_chars FROM z",
    "chunk_fixed_words": r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (SELECT doc_id, 0 AS step, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 500 THEN n ELSE 500 - coalesce(nullif(instr(reverse(regexp_replace(text[402:501], '[\t\n\r]', ' ', 'g')), ' '), 0) - 1, 0) END AS b FROM d WHERE n > 0
  UNION ALL SELECT doc_id, step + 1, s, CASE WHEN s + 500 >= n THEN n ELSE s + 500 - coalesce(nullif(instr(reverse(regexp_replace(text[s + 402:s + 501], '[\t\n\r]', ' ', 'g')), ' '), 0) - 1, 0) END
  FROM (SELECT w.doc_id, step, greatest(b - 50, a + 1) AS s, d.n, d.text FROM w JOIN d USING (doc_id) WHERE b < d.n)),
z AS (SELECT w.*, regexp_replace(text[a + 1:b], '^\s+|\s+$', '', 'g') AS content FROM w JOIN d USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS ci, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total FROM z WHERE content != '')
SELECT format('{}-chunk-{:04d}', doc_id, ci) AS id, content, CAST(a AS INT) AS start_idx, CAST(b AS INT) AS end_idx, total AS total_chunks FROM k""",
    "chunk_stats": f"WITH {CLOSED} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM z GROUP BY source",
    "chunk_context": f"""WITH {CLOSED} SELECT {CID} AS id, CASE WHEN a > 40 THEN '...' ELSE '' END || text[greatest(a - 40, 0) + 1:a] AS context_before, text[b + 1:least(b + 40, n)] || CASE WHEN b + 40 < n THEN '...' ELSE '' END AS context_after, round(a / n, 9) AS position, CAST(length(content) AS INT) AS content_length, md5(content) AS content_hash,
CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 500 AS INT) END AS page, CASE WHEN doc_id % 3 = 0 THEN 2 END AS paragraph FROM z""",
    "embed_hashing": f"""WITH w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), v AS ({_VECTOR.format(w="w")})
SELECT doc_id, CASE WHEN c IS NULL THEN list_transform(range(64), lambda y: 0.0) ELSE list_transform({_UNIT}, lambda y: round(CAST(y AS DOUBLE), 5)) END AS embedding FROM documents LEFT JOIN v ON id = doc_id""",
    "cache_keys": "SELECT doc_id, sha256('hashing:' || text) AS key FROM documents",
    "cache_miss": "SELECT DISTINCT sha256('hashing:' || text) AS key, 64 AS dimension FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en' GROUP BY text HAVING min(doc_id) % 5 != 0)",
    "topk_cosine": ranked(f"list_cosine_similarity({A}, {B})"),
    "topk_l2": ranked(f"1 / (1 + list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))))"),
    "topk_ip": ranked(f"list_inner_product({A}, {B}) - 1"),
    "topk_filtered": ranked(f"list_cosine_similarity({A}, {B})", "b.label = 3"),
    "topk_threshold": ranked(f"list_cosine_similarity({A}, {B})", floor="AND score >= 0.4"),
    "search_passages": f"WITH {PASSAGES} SELECT question_id, rank, chunk_id, round(score, 4) AS score FROM p",
    "rerank_minmax": f"""WITH {PASSAGES}, j AS (SELECT *, len(list_intersect(list_distinct({tokens("question")}), list_distinct({tokens("content")}))) / greatest(len(list_distinct(list_concat({tokens("question")}, {tokens("content")}))), 1) AS s FROM p),
m AS (SELECT *, min(s) OVER (PARTITION BY question_id) AS lo, max(s) OVER (PARTITION BY question_id) AS hi FROM j)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY s DESC, rank) AS INT) AS rank, chunk_id, round(CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM m""",
    "citations_formatted": f"""WITH {PASSAGES} SELECT question_id, chunk_id, '[' || chunk_id || '] (score: ' || {_TWO} || ') ' || {_NAME} || ' — "' || {truncate("content", 100)} || '"' AS "default",
'"' || {truncate("content", 120)} || '" (' || {_NAME} || ', ' || chunk_id || ').' AS mla, {_NAME} || ' (' || chunk_id || ', relevance: ' || {_TWO} || '). "' || {truncate("content", 120)} || '"' AS apa FROM p""",
    "citations_dedupe": f"WITH {PASSAGES} SELECT question_id, rank, chunk_id, CASE WHEN rank % 2 = 0 THEN 'unknown' ELSE source END AS source FROM p",
    "store_upsert": "SELECT vec_id AS id, label FROM embeddings WHERE label NOT IN (3, 4) UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE label IN (3, 4) UNION ALL SELECT vec_id + 1000000000, label FROM embeddings WHERE label = 5",
    "store_delete": "SELECT vec_id AS id, label FROM embeddings WHERE label < 7",
    "get_by_ids": "SELECT vec_id AS id, label FROM embeddings WHERE label = 2",
    "metadata_flat": f"WITH {CLOSED} SELECT {CID} AS id, 'document_id=' || doc_id || ';end_idx=' || b || ';lang=' || lang || ';start_idx=' || a AS flat FROM z",
    "classify_questions": f"""SELECT conv_id, CAST(turn AS BIGINT) AS turn, {classified("text")} AS query_type FROM conversations WHERE role = 'user' UNION ALL SELECT -1, i, {classified(picked(QUESTIONS, "i"))} FROM range({len(QUESTIONS)}) r(i)""",
    "grounding": f"""WITH {scored()} SELECT conv_id, turn, len(p) > 0 AND len(list_filter(p, lambda v: v >= 0.05)) / greatest(len(p), 1) >= 0.5 AS is_grounded, CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda v: v >= 0.05)) / len(p), 4) ELSE 0 END AS confidence,
CAST(len(list_filter(p, lambda v: v >= 0.05)) AS INT) AS supported, CAST(len(list_filter(p, lambda v: v < 0.05)) AS INT) AS unsupported FROM s""",
    "groundedness": f"WITH {OUTCOMES} SELECT conv_id, turn, confidence AS groundedness FROM o",
    "relevance": f"WITH {TURNS} {relevance()}",
    "prompt_build": f"""WITH {TURNS}, p AS (SELECT *, {sentences("answer")} AS ps FROM t),
b AS (SELECT *, CASE WHEN len(ps) = 0 THEN '(No relevant context was found.)' ELSE array_to_string(list_transform(ps, lambda x, i: '[' || i || '] ' || x), chr(10) || chr(10)) END AS block FROM p)
SELECT conv_id, turn, md5(block) AS context, CAST(length(question) + CASE WHEN len(ps) = 0 THEN 83 ELSE length(block) + 108 END AS INT) AS chars FROM b""",
    "retry_decisions": f"WITH {OUTCOMES} SELECT conv_id, turn, CASE WHEN {strip('answer')} != '' AND confidence >= 0.5 THEN 'accept' WHEN cnt > 2 THEN 'refuse' WHEN error IS NOT NULL THEN 'refuse' ELSE 'retry' END AS action FROM o",
    "refusal_messages": f"""WITH {OUTCOMES}, m AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'what is in chapter 3' ELSE question END AS u FROM o)
SELECT conv_id, turn, CASE WHEN regexp_matches(u, {q("(?i)" + STRUCTURAL)}) THEN {q('This system uses semantic search and cannot look up content by chapter, page, or section number. Try asking about a specific topic instead — for example, "Summarize the key points of bicameralism" rather than "Give me the key points of chapter 2".')}
ELSE CASE WHEN conv_id % 3 = 0 THEN 'No relevant documents were found in the knowledge base for: "' || u || '"' WHEN confidence > 0 THEN 'The available evidence was not strong enough to provide a reliable answer (confidence: ' || CAST(round_even(round(confidence, 2) * 100, 0) AS INT) || '%).' ELSE 'The retrieved documents did not contain sufficient information to answer: "' || u || '"' END
|| CASE WHEN error IS NOT NULL THEN ' Additionally, an error occurred: ' || error ELSE '' END || CASE WHEN cnt > 1 THEN ' The system attempted ' || cnt || ' times before giving up.' ELSE '' END || ' Please try rephrasing your question or providing more context.' END AS message FROM m""",
    "refusal_accuracy": f"""WITH {OUTCOMES} SELECT conv_id, turn, (conv_id % 2 = 0) = (confidence < 0.5) AS refusal_correct, CASE WHEN conv_id % 2 = 0 AND confidence < 0.5 THEN 'Correctly refused to answer.' WHEN conv_id % 2 != 0 AND confidence >= 0.5 THEN 'Correctly provided an answer.' WHEN conv_id % 2 = 0 THEN 'Should have refused but provided an answer.' ELSE 'Should have answered but refused: weak' END AS refusal_verdict FROM o""",
    "eval_metrics": f"""WITH {OUTCOMES}, v AS ({relevance()}), g AS (SELECT o.*, relevance, CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda y: round(y, 4) >= 0.3)) / len(p), 4) ELSE 0 END AS grounded, error IS NULL AND confidence >= 0.5 AS answered FROM o JOIN v USING (conv_id, turn))
SELECT count(*) AS total_questions, count(*) FILTER (answered) AS answered, count(*) FILTER (error IS NULL AND confidence < 0.5) AS refused, count(*) FILTER (error IS NOT NULL) AS errors, coalesce(round(avg(grounded) FILTER (answered), 4), 0) AS avg_groundedness, coalesce(round(avg(relevance) FILTER (answered), 4), 0) AS avg_relevance,
coalesce(round(avg(CAST((conv_id % 2 = 0) = (confidence < 0.5) AS DOUBLE)) FILTER (error IS NULL), 4), 0) AS refusal_accuracy, coalesce(round(avg(round(turn * 7.0, 2)), 2), 0) AS avg_latency_ms FROM g""",
    "token_counts": f"SELECT token, count(*) AS times FROM (SELECT unnest({tokens('text')}) AS token FROM documents) GROUP BY token",
}

# Sentences: a mark after . ! or ? before white space, moved behind the white space where a letter follows; a mark behind a newline and its white
# space.  Pieces are then packed one sentence after the other.
_SENTENCES = rf"""WITH RECURSIVE m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1) || '(\s+)([A-Za-z])', '\1' || chr(1) || '\2', 'g'), '(\n\s*)(\S)', '\1' || chr(1) || '\2', 'g') AS t FROM documents WHERE text != ''),
u AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS p, unnest(range(len(string_split(t, chr(1))))) AS i FROM m),
o AS (SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM u),
s AS (SELECT doc_id, {strip("p")} AS s, b - length({rep("p", "^\\s+")}) AS a, b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o WHERE {strip("p")} != ''),
g AS (SELECT doc_id, k, 0 AS c, length(s) AS used FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, CASE WHEN used + length(s) > 1000 THEN c + 1 ELSE c END, CASE WHEN used + length(s) > 1000 THEN length(s) ELSE used + length(s) END FROM g JOIN s ON s.doc_id = g.doc_id AND s.k = g.k + 1)
SELECT format('{{}}-chunk-{{:04d}}', doc_id, c) AS id, string_agg(s, ' ' ORDER BY k) AS content, CAST(min(a) AS INT) AS start_idx, CAST(max(b) AS INT) AS end_idx, CAST(count(*) AS INT) AS sentence_count, CAST(max(c) OVER (PARTITION BY doc_id) + 1 AS INT) AS total_chunks FROM g JOIN s USING (doc_id, k) GROUP BY doc_id, c"""
ORACLES["chunk_sentence"] = _SENTENCES

# The same recursion over texts that are cleaned first.
ORACLES["ingest_counts"] = "SELECT (SELECT count(*) FROM documents) AS documents_count, count(*) AS chunks_count FROM (" + ORACLES["chunk_fixed_words"].replace(
    "d AS (SELECT doc_id, text, length(text) AS n FROM documents)", f"""h AS (SELECT doc_id, {unicode_(html('text'))} AS t FROM documents), g AS (SELECT doc_id, {boilerplate('t')} AS t FROM h),
p AS (SELECT doc_id, {paragraphs('t')} AS text FROM g), d AS MATERIALIZED (SELECT doc_id, text, length(text) AS n FROM p)"""
) + ")"
ORACLES["page_dataset"] = rf"""WITH x AS (SELECT 'f' || doc_id // 16 AS source, doc_id % 16 AS position, CASE doc_id % 5 WHEN 0 THEN CAST(doc_id % 37 + 1 AS VARCHAR) WHEN 1 THEN 'iv' END AS label,
  {strip("CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 3 THEN text || chr(10) || doc_id % 900 ELSE text END")} AS text, CAST(doc_id // 16 % 9 AS INT) AS chapter, CASE WHEN doc_id // 16 % 4 = 0 THEN 10 END AS first_page FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda y: {strip("y")}), lambda y: y != '') AS lines FROM x),
f AS (SELECT *, CASE WHEN text != '' AND first_page IS NULL THEN coalesce(try_cast(label AS INT), try_cast(list_filter(list_concat(lines[1:3], lines[greatest(len(lines) - 2, 1):]), lambda y: regexp_full_match(y, '[0-9]{{1,4}}') AND coalesce(try_cast(y AS INT), 0) > 0)[1] AS INT)) END AS found FROM l)
SELECT chapter, CAST(position + CASE WHEN first_page IS NOT NULL THEN first_page ELSE coalesce((SELECT arg_max(b.found - b.position, b.position) FROM f b WHERE b.source = f.source AND b.position <= f.position AND b.found IS NOT NULL), 1) END AS INT) AS page_number, source, md5(text) AS text_md5 FROM f WHERE text != ''"""
ORACLES["store_changes"] = """SELECT vec_id AS id, label FROM embeddings WHERE label NOT IN (3, 4, 5) UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE label = 4 OR (label = 3 AND vec_id % 2 != 0)
UNION ALL SELECT vec_id, 500 FROM embeddings WHERE label = 5 AND vec_id % 3 = 0"""
ORACLES["token_estimates"] = f"""SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END AS INT) AS by_length,
CAST(floor(CASE WHEN {strip("text")} = '' THEN 0 ELSE len(regexp_split_to_array({strip("text")}, '\\s+')) END * CAST(1.3 AS DOUBLE)) AS INT) AS by_words FROM documents"""
_NO_QUESTION, _NO_RESULTS, _NO_ANSWER = "'question must be a non-empty string'", "'search_results must be present before answer generation'", "'answer must be a non-empty string for grounding check'"
ORACLES["state_problems"] = f"""WITH {TURNS}, s AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 OR {strip("question")} = '' THEN {_NO_QUESTION} END AS q, CASE WHEN conv_id % 3 = 0 THEN {_NO_RESULTS} END AS r, conv_id % 7 = 0 OR {strip("answer")} = '' AS bare FROM t)
SELECT conv_id, turn, coalesce(q, '') AS initial, coalesce(q, '') AS retrieval, concat_ws('; ', q, r) AS answer, concat_ws('; ', q, r, CASE WHEN bare THEN {_NO_ANSWER} END) AS grounding,
CASE WHEN bare AND conv_id % 4 != 0 THEN 'completed state must have an answer, refusal_reason, or error' WHEN NOT bare AND turn * 0.3 > 1 THEN 'confidence must be a float between 0.0 and 1.0' ELSE '' END AS complete FROM s"""
ORACLES["normalized_vectors"] = """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings)
SELECT vec_id, list_transform(embedding, lambda x: round(CAST(CAST(x::DOUBLE / CASE WHEN l > 0 THEN l ELSE 1 END AS FLOAT) AS DOUBLE), 5) + 0.0) AS unit, round(l, 5) AS length FROM n"""
ORACLES["distance_scores"] = f"""WITH p AS (SELECT a.vec_id AS question_id, b.vec_id, list_cosine_similarity({A}, {B}) AS c, list_inner_product({A}, {B}) AS d,
  list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS l FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0)
SELECT question_id, vec_id, round(greatest(0, least(1, c)), 6) AS cosine, round(1 / (1 + greatest(l, 0)), 6) AS l2, round(greatest(0, least(1, -d)), 6) AS ip, round(greatest(0, least(1, 1 - 3 * d)), 6) AS other FROM p"""
ORACLES["cache_embed"] = ORACLES["embed_hashing"]
ORACLES["topk_metadata"] = ORACLES["topk_filtered"]
ORACLES["topk_grid"] = f"""WITH v AS (SELECT vec_id, label, {A.replace("a.", "")} AS e FROM embeddings), r AS (SELECT a.vec_id AS q, b.vec_id AS chunk_id, b.label, round(greatest(0.0, least(1.0, list_cosine_similarity(a.e, b.e))), 12) AS score FROM v a, v b),
n AS (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, round(score, 6) AS score, label FROM r)
SELECT q + more AS question_id, rank, chunk_id, score, label FROM n, (VALUES (0), (1000000), (2000000)) m(more) WHERE rank <= 3"""
ORACLES["attempted_answers"] = """SELECT conv_id, turn, CASE WHEN length(text) % 10 != 0 THEN array_to_string(w[greatest(len(w) - 2, 1):], ' ') END AS value, CASE WHEN length(text) % 10 = 0 THEN 'no answer to ' || length(text) || ' characters' END AS error
FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x != '') AS w FROM conversations WHERE role = 'user')"""
ORACLES["eval_errors"] = """SELECT q AS question, CASE WHEN length(q) % 10 = 0 THEN 'The answer provider failed: no answer to ' || length(q) || ' characters' END AS error, length(q) % 10 != 0 AS scored, length(q) % 10 != 0 AS answered FROM (SELECT 'What is said of ' || text || '?' AS q FROM benchmark)"""
_PARTS = ("avg_groundedness", "avg_relevance", "refusal_accuracy")
_HALF = ORACLES["eval_metrics"].replace("AS avg_latency_ms FROM g", "AS avg_latency_ms FROM g WHERE conv_id % 2 = 0")
ORACLES["eval_delta"] = f"WITH a AS ({ORACLES['eval_metrics']}), b AS ({_HALF})" + " UNION ALL ".join(
    f" SELECT '{m}' AS metric, a.{m} AS now, b.{m} AS base, CASE WHEN abs(a.{m} - b.{m}) < 0.0001 THEN '(=)' ELSE format('({{:+.4f}})', a.{m} - b.{m}) END AS change FROM a, b" for m in _PARTS
)
ORACLES["suite_checks"] = """WITH c AS (SELECT item_id, CASE WHEN item_id % 4 = 3 THEN 'difficulty is easy, medium or hard' WHEN item_id % 5 != 4 AND item_id % 2 = 0 AND item_id % 3 = 0 THEN 'an expected refusal expects no text' END AS problem, item_id % 5 != 4 AND item_id % 2 = 0 AS refused FROM benchmark)
SELECT item_id, 'invalid' AS "check", problem AS said FROM c WHERE problem IS NOT NULL UNION ALL SELECT item_id, 'tag', '' FROM c WHERE item_id % 4 = 0 UNION ALL SELECT item_id, 'difficulty', '' FROM c WHERE item_id % 4 = 2
UNION ALL SELECT item_id, 'refusal', '' FROM c WHERE refused UNION ALL SELECT item_id, 'answerable', '' FROM c WHERE NOT refused"""
_P = {
    1: ("Summarise what these passages say, in short and with the key points listed.\n\nPassages:\n", "\n\nWhat to summarise: ", "\n\nSummary:"),
    2: ("Use these passages as the main source. Connections and proposals are welcome as long as the passages bear them out.\n\nPassages:\n", "\n\nTask: ", "\n\nResponse:"),
    0: ("Answer from these passages alone and say so if they do not hold the answer.\n\nPassages:\n", "\n\nQuestion: ", "\n\nAnswer:"),
}
_FILLED = {k: f"{q(a)} || '[1] ' || answer || chr(10) || chr(10) || '[2] ' || question || {q(b)} || question || {q(c)}" for k, (a, b, c) in _P.items()}
_DECLINED = f"{q('Nothing was found that answers this question. Decline politely.' + chr(10) * 2 + 'Question: ')} || question || {q(chr(10) * 2 + 'Reply:')}"
ORACLES["prompt_classes"] = f"WITH {TURNS} SELECT conv_id, turn, md5(CASE WHEN turn % 4 = 1 THEN {_DECLINED} WHEN conv_id % 4 = 1 THEN {_FILLED[1]} WHEN conv_id % 4 = 2 THEN {_FILLED[2]} ELSE {_FILLED[0]} END) AS prompt FROM t"
