"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from sextant.llm.quality import RULES, STOP_WORDS
from sextant.llm.secrets import KINDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0 AS cap, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source)),
t AS (SELECT source, source_size, CASE WHEN th IS NULL THEN cap ELSE least(cap, th * weight) END AS target
  FROM f, (SELECT arg_min(level, cap / weight) AS th FROM f WHERE level * weight <= cap)),
g AS (SELECT source, length(bin(size)) AS appeal, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY ALL),
gw AS (SELECT g.*, source_size, target, n * 2.0 AS cap, CASE WHEN n = 0 THEN 1.0 ELSE n * appeal END AS weight FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
gf AS (SELECT *, (target - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM gw WINDOW o AS (PARTITION BY source ORDER BY cap / weight, appeal)),
gl AS (SELECT *, arg_min(level, cap / weight) FILTER (level * weight <= cap) OVER (PARTITION BY source) AS th FROM gf),
gm AS (SELECT *, CASE WHEN n > 0 THEN least(CASE WHEN th IS NULL THEN cap ELSE least(cap, th * weight) END / n, 2.0) ELSE 0 END AS mean FROM gl),
r AS (SELECT source, appeal, source_size, target, CAST(floor(mean) AS BIGINT) AS whole, mean - floor(mean) AS lam, target - sum(floor(mean) * n) OVER (PARTITION BY source) AS rest FROM gm),
v AS (SELECT d.*, source_size, target, whole, lam, rest, u * (1 - lam) / (u * (1 - lam) + lam * (1 - u)) AS v FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND length(bin(d.size)) = r.appeal),
q AS (SELECT *, coalesce(sum(size) FILTER (lam > 0) OVER (PARTITION BY source ORDER BY lam > 0 DESC, v, u, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * (whole + CASE WHEN lam > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q
"""


def _op2() -> str:
    stops = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS.split())))
    bound = lambda r: " AND ".join([f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT rid, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'g': array_to_string(w[i:i + 7], ' '), 'i': i}})) AS x FROM d WHERE len(w) >= 8),
twice AS (SELECT rid, x.g AS gram FROM g GROUP BY ALL HAVING count(*) >= 2),
places AS (SELECT DISTINCT g.rid, unnest(range(g.x.i, g.x.i + 8)) AS p FROM g JOIN twice ON g.rid = twice.rid AND g.x.g = twice.gram),
reps AS (SELECT rid, count(*) AS n_repeat_words FROM places GROUP BY rid),
m AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
  len(regexp_extract_all(t, '\p{{Lu}}')) AS caps, len(regexp_extract_all(t, '!')) AS bangs,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN reps USING (rid)),
r AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
  stops / greatest(n_words, 1) AS stop_word_ratio, caps / greatest(word_chars, 1) AS capital_ratio, bangs / greatest(n_words, 1) AS exclamation_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio,
  (len(l) - len(list_distinct(l))) / greatest(len(l), 1) AS dup_line_ratio,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]\x20'))) / greatest(len(l), 1) AS bullet_line_ratio,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) / greatest(len(l), 1) AS ellipsis_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  ({" AND ".join(bound(r) for r in RULES)} AND NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)) AS kept FROM r
"""


OP3 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT rid, unnest(s) AS t FROM g),
i AS (SELECT a.rid AS p, b.rid AS q, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT p, q FROM i JOIN g a ON a.rid = p JOIN g b ON b.rid = q WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
e AS (SELECT p, q FROM l UNION SELECT q, p FROM l),
r AS (SELECT rid AS p, rid AS q FROM g UNION SELECT r.p, e.q FROM r JOIN e ON r.q = e.p)
SELECT a.doc_id, CAST(len(any_value(a.s)) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id FROM r JOIN g a ON a.rid = r.p JOIN g b ON b.rid = r.q GROUP BY a.rid, a.doc_id
"""


def _op4() -> str:
    q = lambda p: p.replace("'", "''")
    lens = "list_transform({}, lambda x: length(x))"
    one = lambda i, k: rf"""
  SELECT rid, doc_id, owner, {i} AS no, '{k.name}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': CAST(list_sum({lens.format("g[1:i]")}) + coalesce(list_sum({lens.format("m[1:i - 1]")}), 0) AS BIGINT), 'm': m[i], 'v': v[i]}})) AS x
  FROM (SELECT rid, doc_id, owner, string_split_regex(t, '{q(k.pattern)}') AS g, regexp_extract_all(t, '{q(k.pattern)}', 0) AS m, regexp_extract_all(t, '{q(k.pattern)}', {k.group}) AS v FROM d)"""  # noqa: E731
    base = ", ".join(f"'{k.name}'" for k in KINDS if k.base)
    least = " ".join(f"WHEN '{k.name}' THEN {k.least}" for k in KINDS)
    said = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no, b)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(one(i, k) for i, k in enumerate(KINDS))}),
f AS (SELECT rid, doc_id, owner, no, kind, x.a AS a, x.a + length(x.m) AS b, sha256(x.v) AS h FROM raw WHERE length(x.v) >= CASE kind {least} END),
own AS (SELECT h, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT (coalesce(owner, chr(0)), coalesce(CAST(doc_id AS VARCHAR), chr(0)))) AS repos FROM f GROUP BY h),
judged AS (SELECT h, CASE WHEN owners >= 3 OR repos >= 10 THEN 'example' WHEN owners = 1 AND repos <= 3 THEN 'live' ELSE 'shared' END AS verdict FROM own),
r AS (SELECT rid, {" ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}," for k in KINDS if k.base)}
  {said} FILTER (kind IN ({base})) AS base, {said} AS spans, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'shared') AS n_shared, count(*) FILTER (verdict = 'example') AS n_example
  FROM f JOIN judged USING (h) GROUP BY rid)
SELECT doc_id, {" ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}," for k in KINDS if k.base)} sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN r USING (rid)
"""


OP5 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS no, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT line, min((doc_id, no)) AS first, length(line) AS n FROM l WHERE length(line) >= 8 GROUP BY line),
g AS (SELECT line, first, n, unnest([{'i': i, 'at': i * (n // 3) + greatest(0, i - (3 - n % 3)), 'size': n // 3 + CAST(i > 2 - n % 3 AS INT)} FOR i IN range(3)]) AS s FROM c WHERE n >= 24),
o AS (SELECT line, n AS len, s.i AS i, line[s.at + 1:s.at + s.size] AS sub FROM g),
q AS (SELECT line, n AS own, unnest(range(greatest(n - 2, 24), n + 1)) AS other FROM c WHERE n >= 24),
r AS (SELECT line, own, other, own - other AS more, unnest([{'i': i, 'at': i * (other // 3) + greatest(0, i - (3 - other % 3)), 'size': other // 3 + CAST(i > 2 - other % 3 AS INT)} FOR i IN range(3)]) AS s FROM q),
p AS (SELECT line, other AS len, s.i AS i, s.size AS size, unnest(range(greatest(s.at - s.i, s.at + more - (2 - s.i), 0), least(s.at + s.i, s.at + more + 2 - s.i, own - s.size) + 1)) AS at FROM r),
m AS (SELECT DISTINCT o.line AS a, p.line AS b FROM o JOIN p ON o.len = p.len AND o.i = p.i AND o.sub = p.line[p.at + 1:p.at + p.size] WHERE o.line != p.line),
near AS (SELECT a, b FROM m WHERE levenshtein(a, b) <= 2),
late AS (SELECT DISTINCT CASE WHEN x.first < y.first THEN b ELSE a END AS line FROM near JOIN c x ON x.line = a JOIN c y ON y.line = b),
h AS (SELECT l.doc_id, no, (l.doc_id, no) > c.first AS again FROM l JOIN c USING (line) LEFT JOIN late ON late.line = l.line WHERE (l.doc_id, no) > c.first OR late.line IS NOT NULL),
u AS (SELECT doc_id, count(DISTINCT no) FILTER (again) AS e, count(DISTINCT no) FILTER (NOT again) AS k, array_to_string(list_sort(list(DISTINCT no)), ',') AS x FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines, coalesce(e, 0) AS n_exact, coalesce(k, 0) AS n_near, coalesce(x, '') AS removed FROM d LEFT JOIN u ON u.doc_id = d.doc_id
"""


OP6 = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(x)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '([<\[])(\\*)(<SYS>>|</SYS>>|s>|/s>|INST\]|/INST\]|\|role:|\|/role\|>)'))
  + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 18 + 2 * strlen(role) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM m GROUP BY conv_id
""".replace("\\", "\\")


OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
r AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || h[i * 8 + 1:i * 8 + 8] AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def _op12() -> str:
    """Every kind as a pattern whose last group is the value; rest: characters of the match after the value."""
    between, user = r"[ \t]*[:#=]?[ \t]*", r"[A-Za-z0-9._~%!$&()*+,;='-]"
    digits = r"regexp_extract_all(v, '[0-9]')"
    luhn = f"list_sum(list_transform(list_reverse({digits}), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0"
    plain = "replace(v, ' ', '')"
    number = f"list_reduce(list_concat([0], list_transform(string_split({plain}[5:] || {plain}[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)), lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"
    kinds = (
        ("email", r"()([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", 0, "true"),
        ("ip", r"()([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", 0, "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INT), 0) > 255)) = 0"),
        ("card", r"()([0-9](?:[\x20-]?[0-9])+)", 0, f"len({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        ("phone", r"()(\+[0-9][\x20().0-9-]+[0-9])", 0, f"len({digits}) BETWEEN 10 AND 15"),
        ("login", rf"((?i:https?|s?ftp|ssh|imap|smtp)://)({user}+:(?:{user}|:)+)@[A-Za-z0-9]", 2, "true"),
        ("iban", rf"(\b(?i:iban)\b{between})([A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?)\b", 0, f"{number} = 1"),
        ("ssn", rf"(\b(?i:ssn\b|social security number\b|social security no\.){between})([0-9]{{3}}[- ][0-9]{{2}}[- ][0-9]{{4}})\b", 0, "v[1:3] NOT IN ('000', '666') AND v[1:1] != '9' AND v[5:6] != '00' AND v[8:] != '0000'"),
        ("account", rf"(\b(?i:account number\b|account no\b\.?|acct no\b\.?|acct\.){between})([0-9]+(?:-[0-9]+)*)\b", 0, f"len({digits}) BETWEEN 6 AND 17"),
        ("passport", rf"(\b(?i:passport\b(?: number\b| no\b\.?)?){between})([A-Z]{{0,2}}[0-9]{{4,9}})\b", 0, "length(v) BETWEEN 6 AND 9"),
    )
    q = lambda p: p.replace("'", "''")
    total = "list_sum(list_transform({}, lambda x: length(x)))"
    found = " UNION ALL ".join(
        f"""
  SELECT rid, {no} AS no, '{kind}' AS kind, x.a + length(x.m) - {rest} - length(x.v) AS a, x.a + length(x.m) - {rest} AS b FROM (SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': CAST({total.format("g[1:i]")} + coalesce({total.format("m[1:i - 1]")}, 0) AS BIGINT), 'm': m[i], 'v': v[i]}})) AS x
    FROM (SELECT rid, string_split_regex(t, '{q(p)}') AS g, regexp_extract_all(t, '{q(p)}', 0) AS m, regexp_extract_all(t, '{q(p)}', 2) AS v FROM d WHERE regexp_matches(t, '{q(p)}'))), (SELECT x.v AS v) WHERE {sound}"""
        for no, (kind, p, rest, sound) in enumerate(kinds)
    )
    said = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no, b)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
r AS (SELECT rid, {" ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}," for k in ("email", "ip", "card", "phone"))} {said} FILTER (no < 4) AS base, {said} AS spans FROM f GROUP BY rid)
SELECT doc_id, {" ".join(f"coalesce(n_{k}, 0) AS n_{k}," for k in ("email", "ip", "card", "phone"))} sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (rid)
"""


ORACLES: dict[str, str] = {"op1_pareto_mix": OP1, "op2_quality_rules": _op2(), "op3_token_groups": OP3, "op4_secret_owners": _op4(), "op5_segment_lines": OP5, "op6_chat_format": OP6, "op9_cover_tree_topk": OP9, "op11_fill_in_middle": OP11, "op12_pii_anchors": _op12()}
