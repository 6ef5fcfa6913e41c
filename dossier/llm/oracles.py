"""SQL of the operators that SQL can express."""

from __future__ import annotations

from dossier.llm import url_templates as urls

# The rules of the URL query, as (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def _rules() -> str:
    rows = []
    for verdict, rule in RULES:
        name, slash, rest = rule.partition("/")
        rows.append(f"('{rule}', '{name}', '{slash}{rest}', '{verdict}')")
    return "rules(rule, name, start, verdict) AS (VALUES " + ", ".join(rows) + ")"


_k = urls.SMOOTHING

URL_TEMPLATES = f"""
WITH RECURSIVE {_rules()},
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{urls.HOST}', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
   coalesce(regexp_extract(url, '{urls.PATH}', 1), '') AS path FROM pages),
numbered AS (SELECT row_number() OVER () AS r, * FROM u),
fits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM numbered, rules
   WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY r),
shaped AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
   CASE WHEN regexp_matches(s, '{urls.VARIABLE}') THEN '*' || regexp_extract(s, '{urls.VARIABLE}', 1) ELSE s END) AS shaped FROM numbered),
given AS (SELECT doc_id AS k, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
rows AS MATERIALIZED (SELECT r, page_id, host, path, shaped AS segs, good FROM shaped
   LEFT JOIN given ON k = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1) AS BIGINT)),
n0 AS MATERIALIZED (SELECT host, segs, count(good) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS good FROM rows GROUP BY ALL),
tree AS (SELECT CAST(0 AS BIGINT) AS level, host, segs, '' AS prefix, n, good FROM n0
   UNION ALL SELECT level + 1, host, segs, CASE WHEN seg = '' THEN prefix WHEN starts_with(seg, '*') THEN prefix || '/' || seg
      WHEN abs(bg - bn * share) > {urls.SIGNIFICANT} * sqrt(bn * share * (1 - share)) THEN prefix || '/' || seg ELSE prefix || '/*' END, n, good
   FROM (SELECT *, sum(n) OVER (PARTITION BY host, prefix, seg) AS bn, sum(good) OVER (PARTITION BY host, prefix, seg) AS bg,
         (sum(good) OVER (PARTITION BY host, prefix) + 0.5e0) / (sum(n) OVER (PARTITION BY host, prefix) + 1.0e0) AS share
      FROM (SELECT *, coalesce(segs[level + 1], '') AS seg FROM tree)) WHERE level < (SELECT max(len(segs)) FROM n0)),
last AS MATERIALIZED (SELECT * FROM tree WHERE level = (SELECT max(level) FROM tree)),
hosts AS (SELECT host, sum(n) AS hn, sum(good) AS hg FROM last GROUP BY host),
prior AS (SELECT (sum(hg) + 1.0e0) / (sum(hn) + 2.0e0) AS p FROM hosts),
templates AS (SELECT host, prefix, (sum(good) + {_k}e0 * any_value((hg + {_k}e0 * p) / (hn + {_k}e0))) / (sum(n) + {_k}e0) AS purity
   FROM last JOIN hosts USING (host), prior GROUP BY host, prefix),
judged AS (SELECT host, segs, purity FROM last JOIN templates USING (host, prefix))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < {urls.LEAST_SHARE} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows LEFT JOIN fits USING (r) JOIN judged USING (host, segs)"""

_digit = "(strpos('0123456789abcdef', substr(s, {at}, 1)) - 1)"
_pair = f"({_digit.format(at='5 * i // 4 + 1')} * 16 + {_digit.format(at='5 * i // 4 + 2')})"
WARC = f"""
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT s, max(page_id) AS owner FROM h GROUP BY s),
judged AS (SELECT *, owner IS NOT NULL AND page_id IS DISTINCT FROM owner AS again FROM h JOIN g USING (s))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({_pair} // CAST(2 ** (3 - 5 * i % 4) AS BIGINT)) % 32) AS BIGINT) + 1, 1)), '') AS payload_digest,
   CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to FROM judged"""

EMBEDDINGS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
   AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
   WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93e0),
reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY reach.r),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least USING (r) LEFT JOIN degree USING (r)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STREAM_DEDUP = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)"""

_hex = "strpos('0123456789ABCDEF', substr(h, 2 * i + {at}, 1)) - 1"
# Two words are one edit apart if one is the other less a character, or both are the same less a character at the same place.
SPELLING = f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS tbl
   FROM (SELECT unnest(range(0, 256)) AS i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
   translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs WHERE length(run) >= 6),
summed AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(0, length(h) // 2), lambda i: ({_hex.format(at=1)}) * 16 + {_hex.format(at=2)}),
   lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc_table),
named AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM named WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 200) AS r(i) WHERE i <= length(word)),
near AS MATERIALIZED (SELECT DISTINCT * FROM (
   SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION ALL SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
   UNION ALL SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY ALL),
formed AS MATERIALIZED (SELECT b.word, b.n_near, CASE WHEN top >= 5 * b.n THEN min(other) END AS form, CASE WHEN top >= 5 * b.n THEN top END AS form_n
   FROM best b JOIN near x ON x.word = b.word AND x.other_n = b.top GROUP BY b.word, b.n, b.n_near, top),
walk AS (SELECT word, form AS stop FROM formed WHERE form IS NOT NULL
   UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.stop WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, stop FROM walk LEFT JOIN formed ON formed.word = walk.stop WHERE formed.form IS NULL)
SELECT word, form, coalesce(stop, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)"""

ORACLES = {"op12_stream_dedup": STREAM_DEDUP, "op13_spelling": SPELLING, "op3_url_templates": URL_TEMPLATES, "op5_warc": WARC, "op8_embeddings": EMBEDDINGS}
