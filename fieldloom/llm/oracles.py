"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import decontamination, quality
from .secrets import BASE_RULES, RULES

WHITE = r"[\x20\x09-\x0D]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINE_DEDUP = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) i FROM s),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{WHITE}', ''), '{WHITE}$', ''), '{_UP}', '{_LOW}') AS key FROM l),
d AS (SELECT key, max(doc_id) last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(d.last_doc <> k.doc_id, false) AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{WHITE}'), lambda x: x <> '') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(ss) g FROM s),
n AS MATERIALIZED (SELECT doc_id, count(*) c FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) n_both FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * n_both >= 80 * (x.c + y.c - n_both)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS top FROM g UNION SELECT g.b, r.top FROM r JOIN g ON r.doc_id = g.a WHERE r.top < g.b),
m AS (SELECT doc_id, min(top) top FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(m.top, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.top, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_CHARS = "length(regexp_replace({0}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
_MARKS = _quoted(quality.MARKS)
_BOILERPLATE = " OR ".join(f"contains(lower(line), {_quoted(x)})" for x in quality.BOILERPLATE)
QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{WHITE}'), lambda x: x <> '') ws, string_split(text, chr(10)) ls FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM w)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) p FROM hit) GROUP BY doc_id),
l AS (SELECT doc_id, i, line, {_CHARS.format("line")} AS chars, length(line) - length(translate(line, {_MARKS}, '')) AS marks,
             length(line) - length(translate(line, '|', '')) AS pipes, len(list_filter(string_split_regex(line, '{WHITE}'), lambda x: x <> '')) AS n
      FROM (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) i FROM w)),
f AS (SELECT *, n > 0 AND (marks * 10 > chars OR pipes >= 3 OR (n < 3 AND NOT contains({_quoted(quality.TERMINAL)}, right(regexp_replace(line, '{WHITE}$', ''), 1))) OR {_BOILERPLATE}) AS fails FROM l),
k AS (SELECT doc_id, count(*) FILTER (WHERE fails) AS n_lines_failed, coalesce(sum(chars) FILTER (WHERE NOT fails), 0)::BIGINT AS kept_chars,
             coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS kept_words, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines
      FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, {_CHARS.format("text")} AS word_chars, length(text) - length(translate(text, {_quoted(quality.SYMBOLS)}, '')) AS n_symbols,
             k.n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, k.n_lines_failed, k.kept_chars, k.kept_words
      FROM w JOIN k USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_failed, kept_chars,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= {quality.LEAST_KEPT} * word_chars AND (n_lines_failed = 0 OR kept_words >= {quality.LEAST_WORDS}) AS kept
FROM b
"""

#: The contract's patterns in RE2; matches shorter than the number are dropped (of group 2 for the first).
_SEARCHED = {
    "assign": ("""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}


def _secrets() -> str:
    parts, kinds = [], [r.kind for r in RULES]
    for k, rule in enumerate(RULES):
        pattern, group, least = _SEARCHED.get(rule.kind, (rule.pattern, 0, 0))
        parts.append(f"""SELECT doc_id, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, m, v, g, {least} AS least FROM
          (SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}, 0) m, regexp_extract_all(text, {_quoted(pattern)}, {group}) v, string_split_regex(text, {_quoted(pattern)}) g FROM t)""")
    n_base = len(BASE_RULES)
    names = "[" + ", ".join(map(_quoted, kinds)) + "]"
    one = f"{names}[kind + 1] || ':' || a || ':' || b"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{r.kind}" for k, r in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({" UNION ALL ".join(parts)}),
q AS (SELECT doc_id, kind, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM p WHERE length(v[i]) >= least),
r AS (SELECT doc_id, kind, a::BIGINT AS a, (a + n)::BIGINT AS b FROM q),
c AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY a, kind) FILTER (WHERE kind < {n_base}) AS base, string_agg({one}, ',' ORDER BY a, kind) AS spans FROM r GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN c USING (doc_id)
"""


def _decontamination() -> str:
    places = lambda m: ", ".join(str(k) for k, c in enumerate(m) if c == "1")
    masks = ", ".join(f"({k}, {len(m)}, [{places(m)}])" for k, m in enumerate(decontamination.MASKS + decontamination.SHORT_MASKS))
    words = f"list_filter(string_split_regex(translate(regexp_replace(coalesce(text, ''), '[!-/:-@\\[-`{{-~]', '', 'g'), '{_UP}', '{_LOW}'), '{WHITE}'), lambda x: x <> '')"
    windows = "array_to_string(list_transform(places, lambda p: ws[i + p + 1]), ' ')"
    return f"""
WITH m(mask, span, places) AS (VALUES {masks}),
d AS (SELECT DISTINCT doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark),
bw AS (SELECT item_id, i, mask, {windows} AS h FROM (SELECT item_id, ws, mask, places, unnest(range(0, len(ws) - span + 1)) i
       FROM b, m WHERE len(ws) >= {decontamination.LEAST_WORDS} AND (mask < {len(decontamination.MASKS)} OR len(ws) <= {decontamination.SHORT}))),
dw AS (SELECT doc_id, i, mask, {windows} AS h FROM (SELECT doc_id, ws, mask, places, unnest(range(0, len(ws) - span + 1)) i FROM d, m WHERE mask IN (SELECT mask FROM bw))),
hit AS (SELECT DISTINCT dw.doc_id, bw.item_id, dw.i - bw.i AS shift FROM dw JOIN bw USING (mask, h)),
o AS (SELECT hit.*, d.ws AS t, b.ws AS q, greatest(0, -shift) AS lo, least(len(b.ws), len(d.ws) - shift) AS hi, least(len(b.ws), {decontamination.SPAN}) AS n FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
f AS (SELECT doc_id, item_id, n, list_max(list_transform(range(lo, hi - n + 1), lambda s: list_sum(list_transform(range(s, s + n), lambda k: CAST(t[k + shift + 1] = q[k + 1] AS INT))))) AS most FROM o WHERE hi - lo >= n),
r AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(most) AS most FROM f WHERE most >= {decontamination.SHARE} * n GROUP BY doc_id)
SELECT x.doc_id, r.items IS NOT NULL AS contaminated, coalesce(len(r.items), 0) AS n_items, coalesce(r.items, []) AS items, coalesce(r.most, 0)::BIGINT AS most_words
FROM documents x LEFT JOIN r ON x.doc_id = r.doc_id
"""


ORACLES = {"op1_benchmark_decontamination": _decontamination(), "op2_quality_rules": QUALITY, "op4_line_dedup": LINE_DEDUP, "op5_minhash_near_dedup": NEAR_DEDUP, "op8_secret_scan": _secrets()}
