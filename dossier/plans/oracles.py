"""The catalogue's queries as plain SQL for a second engine.

Each is written from the meaning of the query, not from the Spark plan: search scores every
document, chunks come from a recursive walk over paragraphs, messages from one running sum.
"""

from __future__ import annotations

import re

from dossier.functions import fixed_values as fixed
from dossier.plans.workload import AGENTS, REPORT_TYPES

NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **slots: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        f"CAST({slots[p]} AS VARCHAR)" if i % 2 else lit(p) for i, p in enumerate(pieces) if i % 2 or p
    ]
    return "(" + " || ".join(parts) + ")"


def choice(options: list[str], number: str) -> str:
    return f"[{', '.join(lit(o) for o in options)}][({number}) % {len(options)} + 1]"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def extract(text: str, question: str, keep: int = 3, separator: str = "'. '") -> str:
    sents = (
        f"list_filter(list_transform(regexp_split_to_array({text}, '[.\\n]+'), "
        "lambda s: trim(s)), lambda s: s <> '')"
    )
    scored = (
        f"list_transform({sents}, lambda s, i: {{'a': -len(list_intersect({tokens(question)}, {tokens('s')})) "
        "- CASE WHEN regexp_matches(s, '[0-9]') THEN 1 ELSE 0 END, 'b': i, 'c': s})"
    )
    best = f"list_sort({scored})[1:{keep}]"
    ordered = f"list_sort(list_transform({best}, lambda x: {{'b': x.b, 'c': x.c}}))"
    return f"array_to_string(list_transform({ordered}, lambda x: x.c), {separator})"


REST = r"""(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*"""
BLOCKS = (
    "p|address|article|aside|blockquote|body|center|details|dialog|dir|div|dl|dd|dt|fieldset|"
    "figcaption|figure|footer|form|header|hgroup|hr|html|li|main|menu|nav|ol|pre|search|section|summary|table|ul"
)
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]|  "


def sub(text: str, pattern: str, replacement: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {replacement}, '{flags}')"


def entities(text: str) -> str:
    """References that occur in the tables: a few names and numbers."""
    for name, char in (
        ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("copy", "'©'"), ("middot", "'·'"),
        ("nbsp", "chr(160)"), ("#150", "'–'"), ("#146", "'’'"), ("#x3c", "'<'"), ("(?:amp|#0*38)", "'&'"),
    ):
        text = sub(text, f"&{name};?", char)
    return text


def seen(html: str) -> str:
    hidden = (
        rf"(?is)<!--.*?(?:-->|\z)|<script(?:[\s/]{REST})?>.*?(?:</script\s*>|\z)"
        rf"|<style(?:[\s/]{REST})?>.*?(?:</style\s*>|\z)"
    )
    return sub(html, hidden, "''")


def text_ctes(source: str, name: str) -> str:
    """``name``(page_id, url, text) of the pages in ``source``."""
    return f"""
{name}_1 AS (SELECT page_id, url, {sub(seen('html'), rf'(?is)^.*?<body(?:[\s/]{REST})?>', "''", '')} AS h FROM {source}),
{name}_2 AS (SELECT page_id, url, {sub(sub(sub(sub('h', rf'(?i)<p(?:[\s/]{REST})?>', 'chr(1)'), rf'(?i)<h[1-5](?:[\s/]{REST})?>', 'chr(1) || chr(4)'), rf'(?i)</h[1-6](?:[\s/]{REST})?>|<h6(?:[\s/]{REST})?>', 'chr(5)'), rf'(?i)</?(?:{BLOCKS})(?:[\s/]{REST})?>', 'chr(2)')} AS h FROM {name}_1),
{name}_3 AS (SELECT page_id, url, string_split({sub('h', rf'(?i)<[a-z/!?]{REST}>', "''")}, chr(1))[2:] AS els FROM {name}_2),
{name}_e AS (SELECT page_id, url, list_transform(els, lambda e: CASE WHEN starts_with(e, chr(4)) THEN replace(split_part(substr(e, 2), chr(5), 1), chr(2), '')
   ELSE split_part(split_part(e, chr(2), 1), chr(5), 1) END) AS els FROM {name}_3),
{name}_4 AS (SELECT page_id, url, {entities(f"array_to_string(els, {NL} || {NL})")} AS t FROM {name}_e),
{name} AS MATERIALIZED (SELECT page_id, url, array_to_string(list_filter(list_transform(
  regexp_split_to_array(t, {lit(BREAK)}), lambda l: {sub('l', f'^{SPACE}|{SPACE}$', "''")}), lambda l: l <> ''), {NL}) AS text FROM {name}_4)"""


def chunk_ctes(source: str, key: str, name: str, limit: int) -> str:
    """``name``(key, part, chunk) of ``source``(key, text)."""
    grows = f"n + length(ps[i + 1]) + 1 <= {limit}"
    return f"""
{name}_p AS (SELECT {key}, string_split(text, {NL}) AS ps FROM {source}),
{name}_w AS (
  SELECT {key}, ps, 1 AS i, CASE WHEN length(ps[1]) + 1 <= {limit} THEN 0 ELSE 1 END AS part, length(ps[1]) + 1 AS n FROM {name}_p
  UNION ALL
  SELECT {key}, ps, i + 1, CASE WHEN {grows} THEN part ELSE part + 1 END,
    CASE WHEN {grows} THEN n + length(ps[i + 1]) + 1 ELSE length(ps[i + 1]) + 1 END
  FROM {name}_w WHERE i < len(ps)),
{name} AS MATERIALIZED (
  SELECT {key}, CAST(part AS BIGINT) AS part, string_agg(ps[i], {NL} ORDER BY i) AS chunk FROM {name}_w GROUP BY {key}, part
  UNION ALL SELECT {key}, 0, '' FROM {name}_p WHERE length(ps[1]) + 1 > {limit})"""


def search_ctes(corpus: str, queries: str, keys: str, name: str) -> str:
    """``name``(keys, doc_key, score, rank): every document that shares a word is scored."""
    return f"""
{name}_l AS MATERIALIZED (SELECT doc_key, {tokens('text')} AS ws FROM {corpus}),
{name}_n AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS DOUBLE) / count(*) AS a FROM {name}_l),
{name}_f AS MATERIALIZED (SELECT doc_key, dl, term, count(*) AS tf FROM (SELECT doc_key, len(ws) AS dl, unnest(ws) AS term FROM {name}_l) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY term),
{name}_q AS (SELECT DISTINCT {keys}, term FROM (SELECT {keys}, unnest({tokens('query')}) AS term FROM {queries})),
{name}_w AS (SELECT doc_key, term, CAST(round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0
   / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a)) * 1000000) AS BIGINT) AS w FROM {name}_f JOIN {name}_d USING (term), {name}_n),
{name}_s AS (SELECT {keys}, doc_key, CAST(sum(w) AS BIGINT) AS score FROM {name}_q JOIN {name}_w USING (term) GROUP BY {keys}, doc_key),
{name} AS MATERIALIZED (SELECT {keys}, doc_key, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_key) AS rank FROM {name}_s) WHERE rank <= 4)"""


# --- inputs ---------------------------------------------------------------

MESSAGES = f"""
bodies AS (SELECT *, to_json({{'task': text,
   'report_type': CASE WHEN turn > 0 AND contains(text, {NL}) THEN '' ELSE {choice(REPORT_TYPES, 'length(text)')} END,
   'agent': CASE WHEN turn <= 5 THEN {choice(AGENTS, 'length(text)')} END}})::VARCHAR AS body FROM conversations),
messages AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'start ' || body
   WHEN 'system' THEN 'start ' || left(body, length(body) - 1) ELSE text END AS message FROM bodies),
cut AS (SELECT conv_id, turn, substr(message, 7) AS body FROM messages WHERE starts_with(message, 'start')),
ingested AS (SELECT conv_id, turn,
   CASE WHEN json_valid(body) THEN json_extract_string(body, '$.task') END AS task,
   CASE WHEN json_valid(body) THEN json_extract_string(body, '$.report_type') END AS report_type,
   CASE WHEN json_valid(body) THEN json_extract_string(body, '$.agent') END AS agent,
   CASE WHEN NOT json_valid(body) THEN 'malformed request' END AS error FROM cut),
checked AS (SELECT * EXCLUDE (error), coalesce(error, CASE WHEN coalesce(task, '') = '' OR coalesce(report_type, '') = ''
   OR coalesce(agent, '') = '' THEN {lit(fixed.NOT_ENOUGH_PARAMETERS)} END) AS error FROM ingested),
accepted AS (SELECT * FROM checked WHERE error IS NULL)"""

ROLES = "roles(agent, role_prompt) AS (VALUES " + ", ".join(
    f"({lit(a)}, {lit(p)})" for a, p in fixed.ROLE_PROMPTS.items()
) + ")"

ROLE_REPLIES = f"""
role_replies AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN to_json({{
   'agent': CASE WHEN NOT contains(text, {NL}) THEN {choice(AGENTS, 'length(text)')} END,
   'agent_role_prompt': CASE WHEN turn <= 1 THEN text END}})::VARCHAR WHEN 'assistant' THEN text END AS reply FROM conversations),
chosen AS (SELECT conv_id, turn,
   CASE WHEN coalesce(json_valid(reply), false) THEN json_extract_string(reply, '$.agent') ELSE {lit(fixed.DEFAULT_AGENT)} END AS agent,
   CASE WHEN coalesce(json_valid(reply), false) THEN json_extract_string(reply, '$.agent_role_prompt')
     ELSE {lit(fixed.ROLE_PROMPTS[fixed.DEFAULT_AGENT])} END AS agent_role_prompt FROM role_replies)"""


def lines_of(table: str, keys: str, lists: str, item: str) -> str:
    return f"""
SELECT {keys}, CAST(i - 1 AS BIGINT) AS {item}_idx, ls[i] AS {item}, NULL::VARCHAR AS error FROM (
  SELECT {keys}, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT {keys}, string_split(text, {NL}) AS ls FROM {table} WHERE {lists}))
UNION ALL SELECT {keys}, NULL, NULL, 'malformed reply' FROM {table} WHERE NOT ({lists})"""


DELTAS = """
cuts AS (SELECT conv_id || '-' || turn AS run_id,
   list_concat(list_concat([NULL::VARCHAR], regexp_extract_all(text, '[^ ]+ *| +')), [NULL::VARCHAR]) AS ds FROM conversations),
deltas AS (SELECT run_id, seq - 1 AS seq, ds[seq] AS delta FROM (SELECT run_id, ds, unnest(range(1, len(ds) + 1)) AS seq FROM cuts))"""

# --- a whole run ----------------------------------------------------------

# Of what starts a run: RUN_TASKS for the given tasks, CONVERSATION_TASKS for start messages.
# Both end in runs(run_id, task, report_type, agent, agent_role_prompt, reply, windows).
RUN_TASKS = f"""
runs_w AS (SELECT item_id AS run_id, text AS task, length(text) % 8 AS kind, string_split({sub('text', r'\s+', "' '")}, ' ') AS w FROM benchmark),
runs_l AS (SELECT run_id, task, kind, {choice(REPORT_TYPES, 'length(task)')} AS report_type, {choice(AGENTS, 'run_id')} AS asked,
   list_transform(range(0, 4), lambda i: array_to_string(w[i * CAST(ceil(len(w) / 4.0) AS BIGINT) + 1 : (i + 1) * CAST(ceil(len(w) / 4.0) AS BIGINT)], ' ')) AS ws
   FROM runs_w),
runs AS MATERIALIZED (SELECT run_id, task, report_type, CASE asked WHEN {lit(fixed.AUTO_AGENT)} THEN 'Travel Agent' ELSE asked END AS agent,
   CASE asked WHEN {lit(fixed.AUTO_AGENT)} THEN 'Guide: ' || task END AS agent_role_prompt,
   CASE kind WHEN 0 THEN '[]' WHEN 1 THEN to_json(ws)::VARCHAR || ' as you asked.' ELSE to_json(ws)::VARCHAR END AS reply,
   CASE kind WHEN 0 THEN [] WHEN 1 THEN NULL ELSE ws END AS windows FROM runs_l),
reported AS (SELECT item_id AS run_id, CASE WHEN length(text) % 3 > 0 THEN 'https://absent.example.org/' || item_id END AS url FROM benchmark)"""

CONVERSATION_TASKS = f"""{MESSAGES},
settled AS (SELECT conv_id || '-' || turn AS run_id, task, report_type, error,
   CASE agent WHEN {lit(fixed.AUTO_AGENT)} THEN 'Travel Agent' ELSE agent END AS agent,
   CASE agent WHEN {lit(fixed.AUTO_AGENT)} THEN 'Guide: ' || task END AS agent_role_prompt FROM checked),
started_w AS (SELECT *, list_filter(string_split({sub('task', SPACE, "' '")}, ' '), lambda x: x <> '') AS w FROM settled WHERE error IS NULL),
runs AS MATERIALIZED (SELECT run_id, task, report_type, agent, agent_role_prompt, w,
   list_transform(range(0, 4), lambda i: array_to_string(w[i * CAST(ceil(len(w) / 4.0) AS BIGINT) + 1 : (i + 1) * CAST(ceil(len(w) / 4.0) AS BIGINT)], ' ')) AS windows
   FROM started_w),
reported AS (SELECT NULL::VARCHAR AS run_id, NULL::VARCHAR AS url WHERE false)"""


def hits_of(tasks: str) -> str:
    return f"""{tasks},
researched AS (SELECT * FROM runs WHERE windows IS NOT NULL),
queries AS MATERIALIZED (SELECT run_id, CAST(i AS BIGINT) AS query_idx, windows[i + 1] AS query FROM (SELECT run_id, windows, unnest(range(0, len(windows))) AS i FROM researched)),
{text_ctes('pages', 'all_text')},
corpus AS (SELECT page_id AS doc_key, text FROM all_text), {search_ctes('corpus', 'queries', 'run_id, query_idx', 'found')},
hits AS MATERIALIZED (SELECT run_id, query_idx, rank, url, score FROM found JOIN pages ON doc_key = page_id
   UNION ALL SELECT run_id, query_idx, 5, reported.url, NULL FROM reported JOIN queries USING (run_id) WHERE query_idx = 0),
visits AS MATERIALIZED (SELECT run_id, query_idx, rank, url, score FROM (
   SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY query_idx, rank) AS o FROM hits) WHERE o = 1)"""


HITS = hits_of(RUN_TASKS)


def lookups_of(tasks: str) -> str:
    return f"""{hits_of(tasks)},
texts AS MATERIALIZED (SELECT page_id, url, text FROM all_text WHERE page_id IN (SELECT max(page_id) FROM pages GROUP BY url)),
lookups AS MATERIALIZED (SELECT v.*, t.page_id, t.text,
   CASE WHEN coalesce(url, '') = '' THEN 'no_url' WHEN t.page_id IS NULL THEN 'no_page' WHEN t.text = '' THEN 'empty_text' ELSE 'ok' END AS status
   FROM visits v LEFT JOIN texts t USING (url))"""


LOOKUPS = lookups_of(RUN_TASKS)


def summaries(limit: int = 8192, tasks: str = RUN_TASKS) -> str:
    return f"""{lookups_of(tasks)},
filled AS (SELECT url, text FROM texts WHERE text <> '' AND url IN (SELECT url FROM visits)), {chunk_ctes('filled', 'url', 'chunks', limit)},
visit_chunks AS MATERIALIZED (SELECT v.run_id, v.query_idx, v.url, q.query, c.part, c.chunk
   FROM visits v JOIN queries q USING (run_id, query_idx) JOIN chunks c USING (url)),
chunk_summaries AS MATERIALIZED (SELECT run_id, query_idx, url, part, {extract('chunk', 'query')} AS summary FROM visit_chunks),
combined AS MATERIALIZED (SELECT run_id, query_idx, url, string_agg(summary, {NL} ORDER BY part) AS combined
   FROM chunk_summaries GROUP BY run_id, query_idx, url)"""


def findings_of(tasks: str) -> str:
    return f"""{summaries(tasks=tasks)},
url_summaries AS MATERIALIZED (SELECT run_id, query_idx, url, {extract('combined', 'query')} AS summary
   FROM combined JOIN queries USING (run_id, query_idx)),
findings AS MATERIALIZED (SELECT l.run_id, l.query_idx, l.rank, l.url,
   l.status,
   CASE l.status WHEN 'no_url' THEN {lit(fixed.NO_URL)} WHEN 'no_page' THEN {fill(fixed.FINDING_ERROR, url='l.url', error="'page not found'")}
     WHEN 'empty_text' THEN {fill(fixed.FINDING_OK, url='l.url', summary=lit(fixed.NO_TEXT))}
     ELSE {fill(fixed.FINDING_OK, url='l.url', summary='s.summary')} END AS content
   FROM lookups l LEFT JOIN url_summaries s USING (run_id, query_idx, url))"""


FINDINGS = findings_of(RUN_TASKS)


def research_of(tasks: str) -> str:
    return f"""{findings_of(tasks)},
results AS MATERIALIZED (SELECT q.run_id, q.query_idx, q.query, coalesce(string_agg(f.content, {NL} ORDER BY f.rank), '') AS result
   FROM queries q LEFT JOIN findings f USING (run_id, query_idx) GROUP BY q.run_id, q.query_idx, q.query),
research AS MATERIALIZED (SELECT r.run_id, coalesce(string_agg(result || {NL} || {NL}, '' ORDER BY query_idx), '') AS research_summary
   FROM researched r LEFT JOIN results USING (run_id) GROUP BY r.run_id)"""


RESEARCH = research_of(RUN_TASKS)

_report_case = " ".join(
    f"WHEN {lit(t)} THEN {fill(p, research_summary='research_summary', question='task')}"
    for t, p in fixed.REPORT_PROMPTS.items()
)
_known = ", ".join(lit(t) for t in fixed.REPORT_PROMPTS)


def reports_of(tasks: str) -> str:
    return f"""{research_of(tasks)},
reports AS MATERIALIZED (SELECT run_id, report_type, {extract('research_summary', 'task', 5, f"'.' || {NL}")} AS report
   FROM runs JOIN research USING (run_id) WHERE report_type IN ({_known}))"""


REPORTS = reports_of(RUN_TASKS)


def duration(micros: str) -> str:
    return (
        f"(CASE {micros} // 86400000000 WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE ({micros} // 86400000000) || ' days, ' END"
        f" || printf('%d:%02d:%02d', {micros} % 86400000000 // 3600000000, {micros} % 3600000000 // 60000000, {micros} % 60000000 // 1000000)"
        f" || CASE WHEN {micros} % 1000000 = 0 THEN '' ELSE printf('.%06d', {micros} % 1000000) END)"
    )


def call_id(chunk: str, question: str) -> str:
    content = fill(fixed.SUMMARY_PROMPT, chunk=chunk, question=question)
    return (
        f"sha256(to_json({{'messages': [{{'role': 'user', 'content': {content}}}], "
        "'model': 'gpt-3.5-turbo-16k', 'temperature': 1.0::DOUBLE})::VARCHAR)"
    )


def two_messages(source: str, keys: str, system: str, user: str) -> str:
    return f"""
SELECT {keys}, 0::BIGINT AS pos, 'system' AS role, {system} AS content FROM {source}
UNION ALL SELECT {keys}, 1, 'user', {user} FROM {source}"""


def log_line(phase: int, no: int, stage: str, source: str, output: str, query_idx="0", seq="0", kind="logs") -> str:
    return (
        f"SELECT run_id, {phase}::INTEGER AS phase, {no}::INTEGER AS stage_no, '{stage}' AS stage, CAST({query_idx} AS BIGINT) AS query_idx, "
        f"CAST({seq} AS BIGINT) AS seq, '{kind}' AS type, {output} AS output FROM {source}"
    )


def _log() -> str:
    """Lines in the order in which one run sends them: its agent, its queries, each query with
    all its pages, the count of words, and, for a report type that exists, the report."""
    asked = "(SELECT v.run_id, v.query_idx, v.rank, coalesce(v.url, 'None') AS url, query FROM visits v JOIN queries USING (run_id, query_idx))"
    sites = f"""(SELECT q.run_id, q.query_idx, coalesce(to_json(list(a.url ORDER BY a.rank) FILTER (a.url IS NOT NULL))::VARCHAR, '[]') AS urls
       FROM queries q LEFT JOIN {asked} a USING (run_id, query_idx) GROUP BY q.run_id, q.query_idx)"""
    path = fill(fixed.REPORT_FILE, directory="run_id", report_type="report_type")
    broken = f"(SELECT run_id, ls, unnest(range(1, len(ls))) AS i FROM (SELECT run_id, string_split(report, {NL}) AS ls FROM reports))"
    parts = [
        log_line(0, 0, "request", "runs", fill(fixed.LOG_INITIATED, agent="coalesce(agent, 'None')")),
        log_line(1, 1, "queries", "runs", fill(fixed.LOG_QUERIES, reply="reply")),
        log_line(2, 2, "query", "queries", fill(fixed.LOG_QUERY, query="query"), "query_idx"),
        log_line(2, 3, "new_url", asked, fill(fixed.LOG_NEW_URL, url="url"), "query_idx", "rank"),
        log_line(2, 4, "sites", sites, fill(fixed.LOG_SITES, urls="urls"), "query_idx"),
        log_line(2, 5, "browse", asked, fill(fixed.LOG_BROWSE, url="url", query="query"), "query_idx", "rank"),
        log_line(2, 6, "finding", "findings WHERE status IN ('ok', 'empty_text')", "'📝 ' || content", "query_idx", "rank"),
        log_line(3, 7, "words", "research", fill(fixed.LOG_WORDS, n="len(string_split(research_summary, ' '))")),
        log_line(4, 8, "writing", f"researched WHERE report_type IN ({_known})", fill(fixed.LOG_WRITING, report_type="report_type", task="task")),
        log_line(4, 9, "report", broken, f"ls[i] || {NL}", "0", "i - 1", "report"),
        log_line(5, 10, "path", "reports", f"replace(url_encode({path}), '%2F', '/')", kind="path"),
        log_line(6, 11, "end", "spans", fill(fixed.LOG_END, end="strftime(e, '%Y-%m-%d %H:%M:%S.%f')")),
        log_line(6, 12, "run_time", "spans", fill(fixed.LOG_RUN_TIME, duration=duration("us"))),
    ]
    spans = """spans AS (SELECT run_id, max(ts) AS e, date_diff('microsecond', min(ts), max(ts)) AS us
   FROM events JOIN reports ON user_id = run_id GROUP BY run_id)"""
    return f"WITH RECURSIVE {REPORTS}, {spans} " + " UNION ALL ".join(parts)


WRAPPED = f"""
wrapped AS (SELECT doc_id AS page_id, 'https://' || source || '.example.org/' || doc_id AS url,
   '<html><body>' || CASE lang WHEN 'en' THEN '<p>' ELSE '<table><tr><td>' END
   || replace(replace(text, '&', '&amp;'), '<', '&lt;') || CASE lang WHEN 'en' THEN '</p>' ELSE '</td></tr></table>' END
   || '</body></html>' AS html FROM documents), {text_ctes('wrapped', 'wrapped_text')}"""

_escaped = "replace(replace(text, '&', '&#00000038;'), '<', '&#x3c;')"
ODD = f"""
odd AS (SELECT doc_id AS page_id, '' AS url, '<html><body><h2><div>' || split_part({_escaped}, {NL}, 1)
   || '</div> &#150; <ul><li>&#146;s</li></ul>tail</h2><p>' || {_escaped} || '<div>unseen</div></body></html>' AS html FROM documents)"""

LINKS = f"""
marked AS (SELECT page_id, url AS base, {sub(sub(seen('html'), rf'(?i)<a((?:[\s/]{REST})?)>', r"chr(1) || '\1' || chr(2)"), r'(?i)</a\s*>', 'chr(3)')} AS h FROM pages),
split_links AS (SELECT page_id, base, list_filter(list_transform(string_split(h, chr(1))[2:], lambda a: {{
   'href': regexp_extract(split_part(a, chr(2), 1), '(?is)\\shref\\s*=\\s*"([^"]*)"', 1),
   'has': regexp_matches(split_part(a, chr(2), 1), '(?is)\\shref\\s*='),
   'body': {entities(sub("split_part(split_part(a, chr(2), 2), chr(3), 1)", rf'(?i)<[a-z/!?]{REST}>', "''"))}}}), lambda a: a.has) AS links FROM marked),
links AS (SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, links[i].body AS text, {entities('links[i].href')} AS href,
   regexp_extract(base, '^[a-z]+://[^/?#]*') || {entities('links[i].href')} AS url
   FROM (SELECT page_id, base, links, unnest(range(1, len(links) + 1)) AS i FROM split_links))"""

DOC_CHUNKS = chunk_ctes("(SELECT doc_id, text FROM documents)", "doc_id", "doc_chunks", 8192)
DOC_SEARCH = f"""
corpus AS (SELECT doc_id AS doc_key, text FROM documents), asked AS (SELECT item_id, text AS query FROM benchmark),
{search_ctes('corpus', 'asked', 'item_id', 'found')}"""

_kept_roles = "coalesce(CASE WHEN agent_role_prompt <> '' THEN agent_role_prompt END, role_prompt, " + lit(fixed.NO_SUCH_AGENT) + ")"
_run_roles = f"(SELECT r.*, {_kept_roles} AS role, research_summary FROM runs r JOIN research USING (run_id) LEFT JOIN roles USING (agent) WHERE report_type IN ({_known}))"
_messages = f"""WITH {DELTAS},
grouped AS (SELECT *, coalesce(sum(CASE WHEN contains(delta, {NL}) THEN 1 ELSE 0 END)
   OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM deltas WHERE delta IS NOT NULL)
SELECT run_id, CAST(g AS BIGINT) AS msg_no, string_agg(delta, '' ORDER BY seq) AS output FROM grouped GROUP BY run_id, g
HAVING contains(string_agg(delta, '' ORDER BY seq), {NL})"""

_full_run = f"""WITH RECURSIVE {reports_of(CONVERSATION_TASKS)}
SELECT s.run_id, s.agent, s.error IS NULL AS accepted, s.error, r.report_type, r.report, replace(url_encode({fill(fixed.REPORT_FILE, directory='s.run_id', report_type='r.report_type')}), '%2F', '/') AS path
FROM settled s LEFT JOIN reports r USING (run_id)"""


ORACLES: dict[str, str] = {
    "request_ingest": f"WITH {MESSAGES} SELECT * FROM ingested",
    "request_validate": f"WITH {MESSAGES} SELECT conv_id, turn, error IS NULL AS accepted, error FROM checked",
    "report_type_resolve": f"WITH {MESSAGES} SELECT conv_id, turn, report_type, report_type IN ({_known}) AS known FROM accepted",
    "role_resolve": f"WITH {ROLE_REPLIES}, {ROLES} SELECT conv_id, turn, agent, {_kept_roles} AS role_prompt FROM chosen LEFT JOIN roles USING (agent)",
    "auto_role": f"WITH {ROLE_REPLIES} SELECT * FROM chosen",
    "settled_agents": f"""WITH {MESSAGES}, {ROLE_REPLIES}, settled AS (SELECT i.conv_id, i.turn, i.task, i.report_type, i.error,
   CASE WHEN i.agent = {lit(fixed.AUTO_AGENT)} THEN c.agent ELSE i.agent END AS agent,
   CASE WHEN i.agent = {lit(fixed.AUTO_AGENT)} THEN c.agent_role_prompt END AS agent_role_prompt
   FROM ingested i JOIN chosen c USING (conv_id, turn)),
judged AS (SELECT conv_id, turn, agent, agent_role_prompt, coalesce(error, CASE WHEN coalesce(task, '') = '' OR coalesce(report_type, '') = ''
   OR coalesce(agent, '') = '' THEN {lit(fixed.NOT_ENOUGH_PARAMETERS)} END) AS error FROM settled)
SELECT conv_id, turn, agent, agent_role_prompt, error IS NULL AS accepted, error FROM judged""",
    "query_fanout": lines_of("conversations", "conv_id, turn", "role = 'assistant'", "query"),
    "concept_fanout": lines_of("documents", "doc_id", "lang = 'en'", "concept"),
    "page_text": f"WITH {text_ctes('pages', 'all_text')} SELECT * FROM all_text",
    "odd_page_text": f"WITH {ODD}, {text_ctes('odd', 'odd_text')} SELECT page_id, text FROM odd_text",
    "page_links": f"WITH {LINKS} SELECT * FROM links",
    "page_top_links": f"WITH {LINKS} SELECT page_id, pos, {fill(fixed.LINK_LABEL, text='text', url='url')} AS label FROM links WHERE pos < 5",
    "text_chunks": f"WITH RECURSIVE {DOC_CHUNKS} SELECT * FROM doc_chunks",
    "empty_text_findings": f"""WITH {WRAPPED} SELECT page_id AS run_id, url, CASE text WHEN '' THEN 'empty_text' ELSE 'ok' END AS status,
   {fill(fixed.FINDING_OK, url='url', summary=f"CASE text WHEN '' THEN {lit(fixed.NO_TEXT)} ELSE {extract('text', chr(39) * 2)} END")} AS content FROM wrapped_text""",
    "term_stats": f"""WITH t AS (SELECT doc_id, {tokens('text')} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS term FROM t)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences, (SELECT count(*) FROM t) AS n_docs,
   (SELECT round(CAST(sum(len(ws)) AS DOUBLE) / count(*), 6) FROM t) AS avg_dl FROM u GROUP BY term""",
    "search_topk": f"WITH {DOC_SEARCH} SELECT item_id, doc_key AS doc_id, score, rank FROM found",
    "hits_json": f"""WITH {DOC_SEARCH} SELECT item_id, to_json(list({{'title': split_part(text, '.', 1), 'href': 'https://example.org/' || doc_id}} ORDER BY rank))::VARCHAR AS hits_json
   FROM found JOIN documents ON doc_key = doc_id GROUP BY item_id""",
    "unvisited_urls": f"WITH {HITS} SELECT * FROM visits",
    "unvisited_after_history": f"""WITH {HITS}, fresh AS (SELECT * FROM hits h WHERE query_idx > 0
   AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_idx = 0 AND o.run_id = h.run_id AND o.url = h.url))
SELECT run_id, query_idx, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY query_idx, rank) AS o FROM fresh) WHERE o = 1""",
    "query_prompts": f"WITH {MESSAGES} SELECT conv_id, turn, {fill(fixed.QUERY_PROMPT, question='task')} AS prompt FROM accepted",
    "role_prompts": f"WITH {MESSAGES}, auto AS (SELECT * FROM ingested WHERE agent = {lit(fixed.AUTO_AGENT)})"
    + two_messages("auto", "conv_id, turn", lit(fixed.ROLE_CHOICE_PROMPT), fill(fixed.ROLE_CHOICE_TASK, task="task")),
    "lesson_prompts": f"""SELECT doc_id, concept_idx, {fill(fixed.LESSON_PROMPT, concept='concept')} AS prompt
   FROM ({lines_of('documents', 'doc_id', "lang = 'en'", 'concept')}) WHERE error IS NULL""",
    "lessons": f"""SELECT doc_id, concept_idx, {extract('prompt', 'prompt')} AS lesson, NULL::VARCHAR AS error
   FROM (SELECT doc_id, concept_idx, {fill(fixed.LESSON_PROMPT, concept='concept')} AS prompt
   FROM ({lines_of('documents', 'doc_id', "lang = 'en'", 'concept')}) WHERE error IS NULL)""",
    "prompt_validate": f"""SELECT doc_id, error IS NULL AS accepted, error FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN {lit(fixed.MODEL_MISSING)}
   WHEN lang <> 'fr' AND n_chars > 8001 THEN {fill(fixed.MAX_TOKENS_OVER, max_tokens='n_chars')}
   WHEN lang NOT IN ('en', 'fr') THEN {lit(fixed.STREAM_TARGET_MISSING)} END AS error FROM documents)""",
    "chunk_prompts": f"""WITH RECURSIVE {summaries()} SELECT run_id, query_idx, url, part, 'user' AS role,
   {fill(fixed.SUMMARY_PROMPT, chunk='chunk', question='query')} AS content FROM visit_chunks""",
    "report_prompts": f"WITH RECURSIVE {RESEARCH}, {ROLES}, ready AS {_run_roles}"
    + two_messages("ready", "run_id, report_type", "role", f"CASE report_type {_report_case} END"),
    "concept_prompts": f"WITH RECURSIVE {RESEARCH} SELECT run_id, {fill(fixed.CONCEPT_PROMPT, research_summary='research_summary', question='task')} AS prompt FROM runs JOIN research USING (run_id)",
    "completions": f"""WITH RECURSIVE {DOC_CHUNKS} SELECT doc_id, part, {call_id('chunk', 'source')} AS prompt_id,
   {extract('chunk', 'source')} AS content, NULL::VARCHAR AS error FROM doc_chunks JOIN documents USING (doc_id)""",
    "retried_completions": f"""WITH RECURSIVE {DOC_CHUNKS}, calls AS (SELECT doc_id, part, chunk, source, length({fill(fixed.SUMMARY_PROMPT, chunk='chunk', question='source')}) % 4 = 3 AS dead
   FROM doc_chunks JOIN documents USING (doc_id))
SELECT doc_id, part, CASE WHEN NOT dead THEN {extract('chunk', 'source')} END AS content, CASE WHEN dead THEN 'busy at try 3' END AS error,
   CASE WHEN dead THEN 3 ELSE 0 END::BIGINT AS tries FROM calls""",
    "pending_prompts": f"""WITH RECURSIVE {DOC_CHUNKS}, calls AS (SELECT lang, {call_id('chunk', 'source')} AS prompt_id FROM doc_chunks JOIN documents USING (doc_id))
SELECT DISTINCT prompt_id, 'gpt-3.5-turbo-16k' AS model, 1.0::DOUBLE AS temperature FROM calls
   WHERE prompt_id NOT IN (SELECT prompt_id FROM calls WHERE lang = 'en')""",
    "chunk_summaries": f"WITH RECURSIVE {summaries()} SELECT * FROM chunk_summaries",
    "combined_summary": f"WITH RECURSIVE {summaries(1000)} SELECT * FROM combined",
    "url_summaries": f"WITH RECURSIVE {FINDINGS} SELECT * FROM url_summaries",
    "topic_summaries": f"SELECT doc_id, {extract('text', 'lang')} AS summary, {fill(fixed.LOG_SUMMARIZING, text='text')} AS output FROM documents",
    "reports": f"WITH RECURSIVE {REPORTS} SELECT * FROM reports",
    "page_lookup": f"WITH {LOOKUPS} SELECT run_id, query_idx, rank, url, page_id, status, text FROM lookups",
    "finding_status": f"WITH RECURSIVE {FINDINGS} SELECT * FROM findings",
    "query_findings": f"WITH RECURSIVE {RESEARCH} SELECT * FROM results",
    "research_summary": f"WITH RECURSIVE {RESEARCH} SELECT * FROM research",
    "research_word_count": f"WITH RECURSIVE {RESEARCH} SELECT run_id, len(string_split(research_summary, ' ')) AS n_words FROM research",
    "source_ledger": f"""WITH RECURSIVE {summaries()}, sizes AS (SELECT url, count(*) AS c, CAST(sum(length(chunk)) AS BIGINT) AS n FROM chunks GROUP BY url)
SELECT run_id, url, query_idx, status, coalesce(c, 0) AS n_chunks, coalesce(n, 0) AS n_chars FROM lookups LEFT JOIN sizes USING (url)""",
    "findings_readback": f"WITH RECURSIVE {RESEARCH} SELECT run_id, string_agg(result || {NL}, '' ORDER BY query_idx) AS all_text FROM results GROUP BY run_id",
    "report_path": f"SELECT doc_id, replace(url_encode({fill(fixed.REPORT_FILE, directory='source', report_type='text')}), '%2F', '/') AS path FROM documents",
    "report_messages": _messages,
    "report_messages_stream": _messages,
    "report_messages_replayed": _messages,
    "findings_overwrite": f"""WITH RECURSIVE {RESEARCH} SELECT run_id, query_idx, result FROM results WHERE run_id % 2 = 0
UNION ALL SELECT run_id, query_idx, 'again: ' || result FROM results WHERE run_id % 2 = 1 AND query_idx > 0""",
    "run_log_stored": _log(),
    "report_text": f"WITH {DELTAS} SELECT run_id, string_agg(delta, '' ORDER BY seq) AS report FROM deltas WHERE delta IS NOT NULL GROUP BY run_id",
    "run_log": _log(),
    "concept_log": f"""SELECT doc_id, {fill(fixed.LOG_CONCEPTS, reply="CASE WHEN lang = 'en' THEN to_json(string_split(text, chr(10)))::VARCHAR ELSE text END")} AS output FROM documents""",
    "full_run": _full_run,
    "run_stream": _full_run,
    "run_duration": f"""WITH d AS (SELECT user_id AS run_id, date_diff('microsecond', min(ts), max(ts)) AS micros FROM events GROUP BY user_id)
SELECT run_id, micros, {fill(fixed.LOG_RUN_TIME, duration=duration('micros'))} AS output FROM d""",
    "memory_records": f"""WITH RECURSIVE {summaries()}
SELECT run_id, query_idx, url, part, 'raw' AS kind, {fill(fixed.MEMORY_RAW, url='url', part='part + 1', chunk='chunk')} AS record FROM visit_chunks
UNION ALL SELECT run_id, query_idx, url, part, 'summary', {fill(fixed.MEMORY_SUMMARY, url='url', part='part + 1', summary='summary')} FROM chunk_summaries""",
}
# The same results by another way of storing their input.
ORACLES["page_lookup_stored"] = ORACLES["page_lookup"]
ORACLES["index_append"] = ORACLES["term_stats"]
