"""DuckDB SQL for the queries whose result SQL can express."""

from __future__ import annotations

from .quality import RULES

_WORD = r"[^\x20\x09-\x0D]+"

MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS lim,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS lvl
  FROM s WINDOW o AS (ORDER BY 3 * source_size / CAST(w AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT lvl AS level FROM f WHERE lim >= lvl * w ORDER BY lim / CAST(w AS DOUBLE), source LIMIT 1),
t AS (
  SELECT source, source_size, least(CAST(lim AS DOUBLE), level * w) AS target FROM f, lvl),
b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - prior)) AS BIGINT) AS taken FROM r
"""


def _escaped(column: str, level: int, role: bool = False) -> str:
    out = column
    if level >= 1:
        out = f"replace({out}, '\\', '\\\\')"
    if level >= 2:
        out = f"replace(replace({out}, '</turn>', '<\\/turn>'), '### ', '#\\## ')"
        if role:
            out = f"replace({out}, ': ', ':\\ ')"
    return out


def _unescaped(column: str) -> str:
    return f"regexp_replace({column}, '\\\\(.)', '\\1', 'gs')"


def _same(level: int) -> str:
    t, r = _escaped("text", level), _escaped("role", level, True)
    free = " AND ".join(f"NOT contains({x}, '{m}')" for x, m in ((t, "</turn>"), (r, "</turn>"), (t, "### "), (r, "### "), (r, ": ")))
    return f"({free} AND {_unescaped(t)} = text AND {_unescaped(r)} = role)"


def _size(level: int) -> str:
    return f"length({_escaped('role', level, True)}) + length({_escaped('text', level)}) + 14"


CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x.turn, x.role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
z AS (SELECT *, CASE WHEN {_same(0)} THEN {_size(0)} WHEN {_same(1)} THEN {_size(1)} ELSE {_size(2)} END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM z GROUP BY conv_id
"""

QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (
  SELECT i, p, array_to_string(w[p:p + 7], ' ') AS k FROM (SELECT i, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
twice AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT i, count(DISTINCT p + o) AS n FROM twice, range(8) t(o) GROUP BY i),
ln AS (
  SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT i, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY i),
s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(ln.n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(ln.n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         len(list_filter(range(2, len(w) + 1), lambda p: w[p] = w[p - 1])) AS n_stutter
  FROM d LEFT JOIN ln USING (i) LEFT JOIN cov USING (i))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT ({' OR '.join(r.sql for r in RULES)}) AS kept
FROM s
"""


def _url_model() -> str:
    from .url_model import BINS, CALIBRATION, ORDER, RULES as URL_RULES, UNIFORM

    fits = []
    for name, verdict in sorted(URL_RULES, key=lambda r: -len(r[0])):
        own, prefix = name.split("/", 1)
        fits.append((f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{prefix}'))", name, verdict))
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    levels = []
    for k in range(ORDER + 1):
        lower_a, lower_r = ("l.la", "l.lr") if k else (f"{UNIFORM}", f"{UNIFORM}")
        join = f"JOIN p{k - 1} l ON l.gram = substr(g.gram, 2, {k})" if k else ""
        levels.append(f"""
g{k} AS (SELECT substr(win, {ORDER + 1 - k}, {k + 1}) AS gram, substr(win, {ORDER + 1 - k}, {k}) AS ctx, sum(a) AS a, sum(r) AS r FROM seen GROUP BY ALL),
c{k} AS (SELECT ctx, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(r) AS nr, count(*) FILTER (r > 0) AS tr FROM g{k} GROUP BY ctx),
p{k} AS (SELECT g.gram, CASE WHEN na > 0 THEN (a + ta * {lower_a}) / (na + ta) ELSE {lower_a} END AS la,
                CASE WHEN nr > 0 THEN (r + tr * {lower_r}) / (nr + tr) ELSE {lower_r} END AS lr
         FROM g{k} g JOIN c{k} USING (ctx) {join}),""")
    start = " || ".join(["chr(2)"] * ORDER)
    return f"""
WITH pg AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM pg),
urls AS (
  SELECT DISTINCT url, CASE by_rule WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END AS label, contains('{CALIBRATION}', substr(md5(url), 1, 1)) AS held
  FROM ruled WHERE url IS NOT NULL),
wins AS (
  SELECT url, label, held, substr({start} || url, i, {ORDER + 1}) AS win
  FROM (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM urls WHERE length(url) > 0)),
seen AS (SELECT win, count(*) FILTER (label = 1 AND NOT held) AS a, count(*) FILTER (label = 0 AND NOT held) AS r FROM wins GROUP BY win),
{''.join(levels)}
sc AS (
  SELECT url, any_value(label) AS label, any_value(held) AS held,
         CAST(floor(sum(CAST(floor((ln(la) - ln(lr)) * 1000000 + 0.5) AS BIGINT)) / (count(*) * {1_000_000.0 / BINS})) AS BIGINT) AS bin
  FROM wins JOIN p{ORDER} ON gram = win GROUP BY url),
h AS (SELECT label, bin FROM sc WHERE held AND label IS NOT NULL),
e AS (SELECT DISTINCT bin AS t FROM h UNION SELECT 0 UNION SELECT greatest(max(bin), 0) + 1 FROM h),
cost AS (
  SELECT t, count(*) FILTER (label = 1 AND bin < t) / CAST(any_value(ng) AS DOUBLE) + count(*) FILTER (label = 0 AND bin >= t) / CAST(any_value(nb) AS DOUBLE) AS c
  FROM e, h, (SELECT count(*) FILTER (label = 1) AS ng, count(*) FILTER (label = 0) AS nb FROM h) GROUP BY t),
thr AS (SELECT CASE WHEN (SELECT count(DISTINCT label) FROM h) < 2 THEN 0 ELSE (SELECT t FROM cost ORDER BY c, abs(t), t LIMIT 1) END AS t)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN sc.bin >= thr.t THEN 'allow' ELSE 'block' END) AS verdict, sc.bin AS score_bin
FROM ruled CROSS JOIN thr LEFT JOIN sc ON sc.url = ruled.url
"""


URLS = _url_model()

LINES = r"""
WITH l AS (
  SELECT doc_id, text, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone ON k.key = gone.key GROUP BY doc_id
"""

# crc32 of a decimal id, bit by bit: a byte goes in by XOR, -1 stands for a shift; 3988292384 is the polynomial (fixed value)
_CRC32 = """xor(4294967295, list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""

TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT conv_id, turn, length(text) AS chars, md5(length(role) || ':' || role || text) AS id FROM t),
o AS (SELECT conv_id, id, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS ord FROM k),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM o GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT p.conv_id, o.ord, o.id, o.chars FROM p JOIN o ON o.conv_id = p.base AND o.ord <= p.m
  UNION ALL SELECT p.conv_id, o.ord - p.h + p.m, o.id, o.chars FROM p JOIN o ON o.conv_id = p.conv_id AND o.ord > p.h),
s AS (
  SELECT conv_id, ord AS depth, chars, string_agg(id, ',') OVER (PARTITION BY conv_id ORDER BY ord) AS path,
         max(ord) OVER (PARTITION BY conv_id) AS last FROM r),
m AS (
  SELECT conv_id, depth, chars, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, depth = last AS ends FROM s
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT depth, path, any_value(parent) AS parent, min(conv_id) AS rep, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
  FROM m GROUP BY depth, path),
ch AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
u AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.parent = n.path),
sub AS (
  SELECT m.depth, m.path, sum(u.own) AS saved, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM u JOIN m ON m.conv_id = u.rep AND m.depth <= u.depth GROUP BY m.depth, m.path)
SELECT u.rep AS conv_id, CAST(u.depth AS BIGINT) AS depth, q.rep AS parent_conv_id, u.n_convs, CAST(u.n_children AS BIGINT) AS n_children,
       CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(u.ended) AS ends_sha256
FROM u JOIN sub ON sub.depth = u.depth AND sub.path = u.path LEFT JOIN u q ON q.path = u.parent AND q.depth = u.depth - 1
"""

MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM x),
p AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
