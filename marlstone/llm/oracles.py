"""DuckDB SQL for the operators' queries, written from their definitions."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD, _PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, word: str = _WORD, lower: bool = True) -> str:
    t = f"coalesce({text}, '')"
    return f"regexp_extract_all({_LOWER.format(t) if lower else t}, '{word}')"


#: crc32 by its definition: each digit of the id's text is added, then eight bits are shifted out.
_CRC = """RECURSIVE crc(doc_id, s, i, c) AS (
  SELECT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(s[i // 9 + 1])::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END
  FROM crc WHERE i < 9 * length(s)),
held AS (SELECT doc_id, xor(c, 4294967295::BIGINT) % 5 = 1 AS held_out FROM crc WHERE i = 9 * length(s))"""
_BASE_SCORES = f"""WITH {_CRC},
w AS (SELECT doc_id, held_out, unnest(list_append({_words('text')}, '')) AS w FROM documents JOIN held USING (doc_id)),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY 1), a AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(a.n) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.5) / (a.n + 0.5 * (a.v + 1)))), 6) AS base_score
FROM w LEFT JOIN c USING (w), a GROUP BY doc_id"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
reach AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT link.v, reach.m FROM reach JOIN link ON reach.doc_id = link.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id, r.m = d.doc_id AS kept
FROM documents d JOIN (SELECT doc_id, min(m) AS m FROM reach GROUP BY 1) r USING (doc_id) LEFT JOIN n USING (doc_id)"""

_ITEMS = f"""WITH b AS (SELECT item_id::VARCHAR AS item, {_words('text', _PLAIN)} AS w FROM benchmark),
win AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM win),
d AS (SELECT doc_id, {_words('text', _PLAIN)} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
place AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
met AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM place),
hit AS (SELECT DISTINCT doc_id, i, k, item FROM met JOIN windows USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: Bytes as two hexadecimal digits each, so a string of 200 bytes is one of 400 digits.
_REPEATS = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
block AS (SELECT doc_id, b, substr(x, 2 * b + 1, 2 * 699) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199, 500)) AS b FROM d WHERE length(x) >= 400)),
place AS (SELECT doc_id, b, y, unnest(range(0, least(500, length(y) // 2 - 199))) AS j FROM block),
win AS (SELECT doc_id, b + j AS i, md5(substr(y, 2 * j + 1, 400)) AS s FROM place),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT s FROM win GROUP BY 1 HAVING count(*) > 1) USING (s)),
edge AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 200 THEN 1 ELSE 0 END AS new FROM twice),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
rest AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(x, 2 * last_ + 1)) AS x, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM cut JOIN d USING (doc_id) JOIN (SELECT doc_id, max(z) AS last_ FROM span GROUP BY 1) USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.x, d.x))) AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)"""

_LINES = f"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM t WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, ls[i] AS line, {_words('ls[i]')} AS w FROM l),
k AS (SELECT doc_id, i, line, len(w) AS n, w, array_to_string(w, ' ') AS s FROM x),
f AS (SELECT s, any_value(w) AS w, any_value(n) AS n, min((doc_id, i)) AS first FROM k WHERE n > 0 GROUP BY 1),
v AS (SELECT s, first, n, unnest(range(1, n + 1)) AS j, w FROM f WHERE n >= 4),
less AS (SELECT s, first, n, j, array_to_string(list_concat(w[:j - 1], w[j + 1:]), ' ') AS r FROM v),
same AS (SELECT n, j, r, min(first) AS e FROM less GROUP BY 1, 2, 3),
near AS (
  SELECT a.s, b.e AS e FROM less a JOIN same b ON a.n = b.n AND a.j = b.j AND a.r = b.r
  UNION ALL SELECT a.s, b.first FROM less a JOIN f b ON a.r = b.s WHERE b.n >= 4
  UNION ALL SELECT b.s, a.first FROM less a JOIN f b ON a.r = b.s WHERE b.n >= 4),
least_ AS (SELECT s, min(e) AS e FROM near GROUP BY 1),
gone AS (SELECT k.*, k.n > 0 AND least(f.first, coalesce(least_.e, f.first)) < (k.doc_id, k.i) AS gone FROM k LEFT JOIN f USING (s) LEFT JOIN least_ USING (s)),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS rest FROM gone GROUP BY 1)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN t.text IS NOT NULL THEN sha256(coalesce(rest, '')) END AS kept_sha256 FROM t LEFT JOIN o USING (doc_id)"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: kind, pattern, the group that is measured, its least length.
_RULES = (
    ("assign", f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40), ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 1),
)
_found = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS m, list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x) >= {least}) AS ok FROM t"
    for rank, (kind, p, group, least) in enumerate(_RULES)
)
_SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({_found}),
e AS (SELECT doc_id, kind, rank, unnest(range(1, len(m) + 1)) AS i, gap, m, ok FROM r WHERE len(m) > 0),
s AS (SELECT doc_id, kind, rank, list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(m[i]) AS n FROM e WHERE ok[i]),
o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS spans FROM s GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN o USING (doc_id)"""

_QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_words('text', lower=False)} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM g),
r AS (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM h JOIN (SELECT doc_id, s FROM h GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, s)),
n AS (SELECT doc_id, count(DISTINCT j) AS n FROM r GROUP BY 1),
b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls, coalesce(n.n, 0) AS n_repeat_words FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b"""

_INFILL = """WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS d FROM u),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS z,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

LLM_ORACLES: dict[str, str] = {
    "op13_fill_in_middle": _INFILL,
    "op2_minhash_neardup": _NEAR, "op3_decontamination": _ITEMS, "op4_suffix_dedup": _REPEATS, "op5_line_dedup": _LINES, "op7_secret_scan": _SECRETS,
    "lm_base_scores": _BASE_SCORES, "quality_base": _QUALITY,
}
